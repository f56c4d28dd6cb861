"""Statistics by sample, as typed columns and as the fixed-width report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

WIDTH = 25
TITLES = [
    ("barcode", "Forwards Barcodes"), ("r_barcode", "Reversed Barcodes"), ("reads", "Reads"), ("share_reads", "% of Total Reads"), ("merged", "Merged Count"), ("share_merged", "% Merged"),
    ("dedup", "Deduplicated Count"), ("share_dedup", "% Deduplicated"), ("adapters", "Removed Adapter Count"), ("share_adapters", "% Removed Adapter"),
    ("trimmed", "Quality Trimmed Count"), ("share_trimmed", "% Quality Trimmed"), ("bases", "BP Count"), ("share_bases", "% of Total BP Count"),
]


def counts(df: DataFrame, by: str = "sample") -> DataFrame:
    """Sums of n_reads, n_bases, n_merged, n_adapters, n_trimmed and n_duplicates by sample."""
    return df.groupBy(by).agg(*[F.sum(f"n_{k}").cast("long").alias(k) for k in ("reads", "bases", "merged", "adapters", "trimmed", "duplicates")])


def with_total(by_sample: DataFrame, by: str = "sample") -> DataFrame:
    """`by_sample` and a row Total, which sums them."""
    names = [c for c in by_sample.columns if c != by]
    rolled = by_sample.rollup(by).agg(*[F.sum(c).cast("long").alias(c) for c in names], F.grouping(by).alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, F.lit("Total")).otherwise(F.col(by)).alias(by), *names)


def shares(totals: DataFrame, by: str = "sample") -> DataFrame:
    """Shares of reads, merged reads and bases in all; of adapters, trims and duplicates in the row's own reads. 0 of 0 is 0."""
    w = Window.partitionBy()
    total = lambda c: F.max(F.when(F.col(by) == "Total", F.col(c))).over(w)
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    own = F.col("reads").cast("double")
    return totals.select(
        "*",
        part("reads", total("reads")).alias("share_reads"),
        part("merged", total("reads")).alias("share_merged"),
        part("duplicates", own).alias("share_dedup"),
        part("adapters", own).alias("share_adapters"),
        part("trimmed", own).alias("share_trimmed"),
        part("bases", total("bases")).alias("share_bases"),
    )


def report(shared: DataFrame, barcodes: dict[str, tuple[str, str | None]] | None = None, by: str = "sample") -> DataFrame:
    """Lines of the report: n (their order) and line, title first, samples in the sheet's order, then Undetermined and Total."""
    spark, sheet = shared.sparkSession, barcodes or {}
    has_reverse = any(r for _, r in sheet.values())
    columns = [(k, t) for k, t in TITLES if k != "r_barcode" or has_reverse]
    order = [*(sheet or ["Kept"]), "Undetermined", "Total"]
    known = spark.createDataFrame([(i + 1, k, *(sheet.get(k) or ("", ""))) for i, k in enumerate(order)], "n int, name string, barcode string, r_barcode string")
    met = known.join(shared, known["name"] == shared[by], "left")
    cell = lambda k: F.coalesce(F.col(k), F.lit("")) if k in ("barcode", "r_barcode") else S.decimal_text(F.coalesce(F.col("duplicates" if k == "dedup" else k), F.lit(0)))
    line = F.concat_ws(" ", F.rpad("name", WIDTH, " "), *[F.rpad(cell(k), WIDTH, " ") for k, _ in columns])
    title = " ".join(x.ljust(WIDTH) for x in ["Sample" if sheet else "File", *[t for _, t in columns]])
    return spark.createDataFrame([(0, title)], "n int, line string").union(met.select("n", line.alias("line")))
