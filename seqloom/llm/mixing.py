"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

Every document's number of copies is the Poisson quantile of a uniform number
hashed from a seed and its id; the mean is its source's repetition rate. So
the mixture has the target weights in expectation, each document is decided on
its own, and a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_names, partitions_for

STEP = 16.0  # a Poisson number of a larger mean is the sum of independent ones of this mean at most
FEW_SOURCES = 10_000  # 8 MB of rates and distributions
TERMS = 80  # of the distribution function; at mean 16 what is left lies far below 2**-52


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS, with p(k) = p(k - 1) * rate / k, as an array."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda s, k: F.struct(
            (s["p"] * rate / k.cast("double")).alias("p"),
            F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + s["p"] * rate / k.cast("double"))).alias("sums"),
        ),
        lambda s: s["sums"],
    )


def source_rates(df: DataFrame, source: Column, weights: dict[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """key, rate, parts and cdf of each source: rate = epochs * rows * weight / rows of the source."""
    spark = df.sparkSession
    n = df.groupBy(source.alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        weighed = n.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(alpha)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "__key string, __w double")
        weighed = n.join(given, n["__key"].eqNullSafe(given["__key"]), "left").select(n["__key"], "__n", F.coalesce("__w", F.lit(0.0)).alias("__w"))
    total = weighed.agg(F.sum("__n").alias("__all"), F.sum("__w").alias("__sum"))
    rate = F.lit(epochs) * F.col("__all") * F.try_divide(F.col("__w"), F.col("__sum")) / F.col("__n")
    rated = weighed.join(F.broadcast(total)).select("__key", F.coalesce(rate, F.lit(0.0)).alias("__rate"))  # one row
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / STEP)).cast("int")
    return rated.withColumn("__parts", parts).withColumn("__cdf", poisson_cdf(F.col("__rate") / F.col("__parts")))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """Each row of `df` as often as its Poisson number says, in a global random order, with columns copy (from 1), n_copies and mix_key.

    The mean of a row's number is epochs * rows * weight of its source / rows
    of its source. `weights` names the target weight of each source (others
    get 0); without it a source of n rows weighs n ** alpha. Rows are dealt to
    partitions by the hash of mix_key and sorted by it there: mix_key is the
    MD5 of seed, id and copy, so that is a random order of all rows.

    A null source is a source of its own. Rows that repeat an id get the same
    number each; rows with a null id share one number. An empty table gives an
    empty one. The added names get leading underscores where `df` has them.
    """
    copy, copies, key = free_names(df, "copy", "n_copies", "mix_key")
    rates = source_rates(df, column(df, source_col).cast("string"), weights, alpha, epochs)
    if rates.count() <= FEW_SOURCES:  # else a join by source, whose large partitions Spark splits
        rates = F.broadcast(rates)
    rated = df.join(rates, column(df, source_col).cast("string").eqNullSafe(rates["__key"]))
    ident = F.coalesce(column(df, id_col).cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda i: uniform(F.lit(str(seed)), ident, i.cast("string")))
    number = F.aggregate(draws, F.lit(0), lambda s, u: s + F.size(F.filter(F.col("__cdf"), lambda c: c <= u)))
    drawn = rated.withColumn(copies, number).drop("__key", "__rate", "__parts", "__cdf").where(F.col(copies) > 0)
    each = drawn.select("*", F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy))
    keyed = each.withColumn(key, F.md5(F.concat_ws("|", F.lit(f"order{seed}"), ident, F.col(copy).cast("string"))))
    return keyed.repartition(partitions_for(df.sparkSession), key).sortWithinPartitions(key)


ORACLE_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS total, sum(pow(CAST(n AS DOUBLE), 0.5)) AS w FROM n),
r AS (SELECT source, CAST(1.0 AS DOUBLE) * CAST(total AS DOUBLE) * (pow(CAST(n AS DOUBLE), 0.5) / w) / n AS rate FROM n, t),
parts AS (SELECT source, rate, CAST(greatest(1, ceil(rate / 16.0)) AS BIGINT) AS parts FROM r),
terms AS (
  WITH RECURSIVE p AS (
    SELECT source, 0 AS k, rate / parts AS m, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM parts
    UNION ALL
    SELECT source, k + 1, m, p * m / (k + 1), c + p * m / (k + 1) FROM p WHERE k < 80)
  SELECT source, c FROM p),
docs AS (
  SELECT row_number() OVER () AS pos, doc_id, source, lang, n_chars, sha256(text) AS text_sha256, coalesce(CAST(doc_id AS VARCHAR), 'null') AS ident
  FROM documents),
draws AS (
  SELECT pos, d.source,
         CAST(CAST('0x' || substr(md5('17|' || ident || '|' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM docs d JOIN parts s ON d.source IS NOT DISTINCT FROM s.source, unnest(range(1, parts + 1)) AS x(i)),
numbers AS (
  SELECT pos, count(*) AS n_copies
  FROM draws d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND t.c <= d.u
  GROUP BY pos)
SELECT doc_id, source, lang, n_chars, text_sha256, CAST(n_copies AS INT) AS n_copies, CAST(copy AS INT) AS copy,
       md5('order17|' || ident || '|' || CAST(copy AS VARCHAR)) AS mix_key
FROM docs JOIN numbers USING (pos), unnest(range(1, n_copies + 1)) AS y(copy)
"""
