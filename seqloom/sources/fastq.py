"""FASTQ files as DataFrames: a data source, joins by record number, and partitioned sinks."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ord long, header string, seq string, qual string"


class FastqSource(DataSource):
    """format("fastq"): records of local FASTQ files, plain or .gz / .gzip by each file's own name.

    Options: path (files parted by commas; ord starts at 0 in each), strict
    ("true": a header without @, a base outside ACGTN or a quality of another
    length is an error). Each file is one task; for large files in a store that
    all executors reach, read_fastq_text reads in splits.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options["path"].split(","), self.options.get("strict", "false").lower() == "true")


class FastqReader(DataSourceReader):
    def __init__(self, paths: list[str], strict: bool):
        self.paths, self.strict = paths, strict

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        raw = gzip.open(path, "rb") if path.lower().endswith((".gz", ".gzip")) else open(path, "rb")
        with raw, io.TextIOWrapper(raw, encoding="utf-8", newline=None) as f:
            for ord_, record in enumerate(records(f)):
                if self.strict:
                    check(ord_, *record)
                yield (ord_, *record)


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """(header, seq, qual) of four lines each; what the third line says is ignored, an incomplete last record is dropped."""
    held: list[str] = []
    for line in lines:
        held.append(line.rstrip("\n"))
        if len(held) == 4:
            yield held[0], held[1], held[3]
            held = []


def check(ord_: int, header: str, seq: str, qual: str) -> None:
    if not header.startswith("@") or seq.strip("ACGTNacgtn") or len(seq) != len(qual):
        raise ValueError(f"record {ord_} ({header!r}) isn't a valid FASTQ record")


def read_fastq(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("path", path).option("strict", str(strict).lower()).load()


def read_fastq_text(spark: SparkSession, path: str) -> DataFrame:
    """The same records of any files that Spark reads (object stores, folders), however large: file, ord, header, seq, qual.

    Plain files are read in splits. A first pass over them counts each split's
    lines, which tells where the numbers of its lines start; lines then meet by
    record. A record's quality may begin with @, so numbers alone decide what a
    line is. Compressed files are one split each.
    """
    meta = lambda k: F.col(f"_metadata.{k}").alias(k)
    lines = spark.read.text(path).select(meta("file_path"), meta("file_block_start"), F.monotonically_increasing_id().alias("at"), "value")
    order = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file_path", "file_block_start").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    numbered = lines.join(splits, ["file_path", "file_block_start"]).select("file_path", (F.col("before") + F.col("at") - F.col("first")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    met = numbered.groupBy(F.col("file_path").alias("file"), F.floor(F.col("line") / 4).alias("ord")).agg(part(0).alias("header"), part(1).alias("seq"), part(3).alias("qual"), F.count("*").alias("n"))
    return met.where("n = 4").drop("n")


def read_reads(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """ord, header, seq and qual of one file: by the FASTQ source for a plain path, by Spark's own reader for an address with a scheme."""
    if "://" not in path:
        return read_fastq(spark, path, strict)
    found = read_fastq_text(spark, path).select("ord", "header", "seq", "qual")
    if not strict:
        return found
    good = F.col("header").startswith("@") & F.col("seq").rlike("^[ACGTNacgtn]*$") & (F.length("seq") == F.length("qual"))
    return found.withColumn("header", F.when(good, F.col("header")).otherwise(F.raise_error(F.format_string("record %d isn't a valid FASTQ record", "ord"))))


def records_of(whole: DataFrame) -> DataFrame:
    """Records of whole files in column value, of a batch or of a stream."""
    whole = whole.select(F.input_file_name().alias("file"), F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n").alias("lines"))
    n = F.floor(F.size("lines") / 4).cast("int")
    each = whole.where(n > 0).select("file", "lines", F.explode(F.sequence(F.lit(0), n - 1)).alias("ord"))
    line = lambda k: F.element_at("lines", F.col("ord") * 4 + k)
    return each.select("file", F.col("ord").cast("long").alias("ord"), line(1).alias("header"), line(2).alias("seq"), line(4).alias("qual"))


def join_files(f: DataFrame, r: DataFrame | None = None, i1: DataFrame | None = None, i2: DataFrame | None = None) -> DataFrame:
    """The nth records of all files side by side (f_, r_, i1_, i2_ columns), up to the end of the shortest; headers aren't compared."""
    name = lambda df, p: df.select("ord", *[F.col(c).alias(f"{p}_{c}") for c in ("header", "seq", "qual")])
    out = name(f, "f")
    for df, p in ((r, "r"), (i1, "i1"), (i2, "i2")):
        if df is not None:
            out = out.join(name(df, p), "ord")
    return out


def fastq_record(header: Column, seq: Column, qual: Column) -> Column:
    return F.concat_ws("\n", header, seq, F.lit("+"), qual)


def write_fastq(df: DataFrame, path: str, by: list[str], header: str = "header", seq: str = "seq", qual: str = "qual", ord_col: str = "ord", gz: bool = False, mode: str = "errorifexists") -> None:
    """A folder for each value of `by`, with records in order in its files, one after the other by name; folders exist only for values that occur.

    Rows are dealt by ranges of (by, ord), so a large sample has many files and no single task.
    """
    rows = df.select(*by, ord_col, fastq_record(F.col(header), F.col(seq), F.col(qual)).alias("value"))
    ordered = rows.repartitionByRange(*by, ord_col).sortWithinPartitions(*by, ord_col).drop(ord_col)
    ordered.write.mode(mode).partitionBy(*by).option("compression", "gzip" if gz else "none").text(path)


def write_pairs(df: DataFrame, path: str, by: list[str], gz: bool = False, mode: str = "errorifexists") -> None:
    """As `write_fastq`, forward and reverse reads one after the other in the same file."""
    mate = lambda k, m: F.struct(F.lit(k).alias("mate"), F.col(f"{m}_header").alias("header"), F.col(f"{m}_seq").alias("seq"), F.col(f"{m}_qual").alias("qual"))
    each = df.select(*by, "ord", F.explode(F.array(mate(0, "f"), mate(1, "r"))).alias("x"))
    write_fastq(each.select(*by, (F.col("ord") * 2 + F.col("x.mate")).alias("ord"), "x.header", "x.seq", "x.qual"), path, by, gz=gz, mode=mode)


def read_written(spark: SparkSession, path: str, by: str) -> DataFrame:
    """`by`, ord (in its folder, from 0), header, seq and qual of what `write_fastq` wrote."""
    found = read_fastq_text(spark, path + f"/{by}=*")
    folder = F.url_decode(F.regexp_extract("file", rf"/{by}=([^/]*)/", 1))
    sizes = found.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", folder.alias(by), "n")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(sizes.select("file", by, before.alias("before")), "file").select(by, (F.col("ord") + F.col("before")).alias("ord"), "header", "seq", "qual")


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """name, barcode, enzyme, r_enzyme and r_barcode of a sheet whose columns are parted by blanks; barcodes and enzymes in upper case."""
    part = F.split(F.trim("value"), r"\s+")
    at = lambda k: F.when(F.size(part) >= k, F.upper(F.element_at(part, k)))
    return spark.read.text(path).where(F.trim("value") != "").select(F.element_at(part, 1).alias("name"), at(2).alias("barcode"), at(3).alias("enzyme"), F.coalesce(at(4), at(3)).alias("r_enzyme"), at(5).alias("r_barcode"))
