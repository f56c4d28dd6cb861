"""What the text-corpus operators share: tables, scratch tables and column names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# While a scratch table is written: shuffle files go as soon as it is there, and Python gets its rows in smaller batches.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` of the data folder, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one on a local master; else an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="seqloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends, if nothing deletes it before."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: its lineage ends there, and lost executors can't take it along."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqloom/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    deleted_at_exit(spark, path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.scratch_path = path
    return table_


def delete_written(*tables: DataFrame) -> None:
    """Deletes what `written` wrote, once nothing reads it any more."""
    for df in tables:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that `df` doesn't have, in any case, one for each wanted name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str):
    """The column of this exact name, dots and spaces included."""
    return df["`" + name.replace("`", "``") + "`"]


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id and text alone, whatever else `df` holds."""
    return df.select(column(df, id_col).cast("long").alias("id"), column(df, text_col).cast("string").alias("text"))


def beside(df: DataFrame, col: str, keep: Iterable[str], *added: tuple[str, T.DataType]) -> tuple[DataFrame, T.StructType]:
    """`col` as the first column and `keep` after it, and the schema of `keep` with the added columns.

    Python code takes the columns by position, so no name can clash; added
    names that `keep` has already get leading underscores.
    """
    kept = [column(df, c) for c in keep]
    fields = df.select(*kept).schema.fields
    narrow = df.select(column(df, col).alias("c"), *[c.alias(f"c{i}") for i, c in enumerate(kept)])
    names = free_names(df.select(*kept), *[n for n, _ in added])
    return narrow, T.StructType([*fields, *[T.StructField(n, t) for n, (_, t) in zip(names, added, strict=True)]])


def with_columns(part: pa.RecordBatch, names: list[str], *cols: pa.Array) -> pa.RecordBatch:
    """All columns but the first, and the new ones."""
    return pa.RecordBatch.from_arrays([*part.columns[1:], *cols], names=names)


def give_back() -> None:
    """Returns freed memory to the system: an idle Python worker otherwise keeps what its last task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, col: str | int, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose `col` holds about `size` bytes each; a longer row stands alone."""
    lens = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lens):
        if i > start and held + n > size:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lens):
        yield start, len(lens)


def dealt_anew(col: str):
    """An integer column as an expression that hides how its rows are dealt.

    A join of rows with an aggregate over the same key otherwise keeps the
    aggregate's partitions, and Spark can't split a frequent key's rows there.
    """
    return F.col(col).bitwiseXOR(F.lit(0).cast("bigint")).alias(col)


def partitions_for(spark: SparkSession, floor: int = 1) -> int:
    """The session's number of shuffle partitions, `floor` at least."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))
