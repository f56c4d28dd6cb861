"""Reads as a stream: FASTQ files that arrive in a folder go through the same plan as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..plans.config import Config
from ..plans.process import process
from ..sources.fastq import fastq_record, records_of


def read_stream(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """Single reads (ord, f_header, f_seq, f_qual, file) of each FASTQ file once, when it appears in the folder."""
    found = records_of(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder, wholetext=True))
    return found.select("ord", F.col("header").alias("f_header"), F.col("seq").alias("f_seq"), F.col("qual").alias("f_qual"), "file")


def distinct_umis(stream: DataFrame, index_seq: str, size: int, time_col: str, late: str, by: list[str] | None = None) -> DataFrame:
    """The first read of each UMI that arrives within the watermark; state older than that is dropped."""
    keyed = stream.withColumn("umi", S.umi(index_seq, size)).where("umi is not null")
    return keyed.withWatermark(time_col, late).dropDuplicatesWithinWatermark([*(by or []), "umi"])


def write_stream(stream: DataFrame, config: Config, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's reads as FASTQ, a folder for each sample; a batch that is run again replaces its own files."""
    if config.dedup is not None:
        raise ValueError("deduplicate a stream with distinct_umis")

    def write(batch: DataFrame, number: int) -> None:
        done = process(batch, config)
        rows = done.select("sample", fastq_record(F.col("f_header"), F.col("f_seq"), F.col("f_qual")).alias("value"))
        rows.write.mode("overwrite").partitionBy("sample").text(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
