"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, delete_written, written


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the least node around it."""
    both = links.select("a", "b").union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(dealt_anew("u"), "m")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u"), "m")
    met = down.join(least, "u")
    return met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(met.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node and root (the least id of its component) for every node of `links` (a, b) but the roots themselves.

    Links stay in tables in the shared folder, one a round, and never reach
    the driver; rounds grow with the logarithm of the nodes.
    """
    now = written(links.select("a", "b").where("a <> b").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        new = written(_small_star(_large_star(now)), "links")
        delete_written(now)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
