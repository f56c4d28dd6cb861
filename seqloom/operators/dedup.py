"""UMI deduplication: one read for each sample and UMI, by a window and never by a driver-side set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .quality import with_quality


def mark_duplicates(df: DataFrame, umi: Column, by: list[str], order: list[Column]) -> DataFrame:
    """`df` with umi and duplicate (null without a UMI): all but the first of each (by, umi) in the given order.

    Rows without a UMI are dealt by their order instead: they are no group.
    """
    keyed = df.withColumn("umi", umi)
    alone = F.when(F.col("umi").isNull(), F.xxhash64(*order))
    w = Window.partitionBy(*by, "umi", alone).orderBy(*order)
    return keyed.withColumn("duplicate", F.when(F.col("umi").isNotNull(), F.row_number().over(w) > 1))


def first_read(df: DataFrame, index_seq: str, size: int = 12, by: list[str] | None = None, ord_col: str = "ord") -> DataFrame:
    """Keeps the first read of each UMI; index reads that are shorter than it have none and go."""
    best = df.withColumn("umi", S.umi(index_seq, size)).where("umi is not null")
    keys = [*(by or []), "umi"]
    return best.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.col(ord_col)).alias("r")).select("r.*", "umi")


def best_read(df: DataFrame, index_seq: str, quals: list[str], size: int = 12, by: list[str] | None = None, ord_col: str = "ord") -> DataFrame:
    """Keeps the read with the fewest expected errors of each UMI, the first of equals."""
    best = df.withColumn("umi", S.umi(index_seq, size)).where("umi is not null")
    for k, q in enumerate(quals):
        best = with_quality(best, q, f"_mean{k}", f"_errors{k}")
    best = best.withColumn("errors", sum((F.col(f"_errors{k}") for k in range(len(quals))), F.lit(0.0)))
    keys = [*(by or []), "umi"]
    return best.groupBy(*keys).agg(F.min_by(F.struct(*df.columns, "errors"), F.struct("errors", ord_col)).alias("r")).select("r.*", "umi")
