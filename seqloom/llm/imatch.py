"""I-Match fingerprints, in DataFrame functions alone.

The lexicon holds the terms whose share of the documents lies in a band, that
is, whose inverse document frequency does. A fingerprint hashes a document's
sorted distinct lexicon terms: all of them first, then those in each of
SUBSETS random subsets of the lexicon, whose sizes fall from a quarter to a 256th.
Small subsets often miss what an edit changed, large ones are strict, so the
share of equal hashes grows with what two texts have in common.

Terms in more than `low` of the documents are at most (mean distinct terms of a
document) / `low`, whatever the corpus's size. A lexicon of up to BROADCAST_TERMS
terms, counted before, is broadcast; a larger one is joined.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, partitions_for, written

LEVELS = [2, 3, 4, 4, *[5] * 4, *[6] * 6, *[7] * 8, *[8] * 10]  # subset k holds one term in 2 ** LEVELS[k]
SUBSETS = len(LEVELS)
LOW, HIGH = 0.002, 0.05
MAX_BUCKETS = 1 << 15  # ranges of ids; the cuts are part of the plan
BROADCAST_TERMS = 2_000_000  # a larger lexicon is joined instead


def terms(text: Column) -> Column:
    """Distinct runs of letters and digits, in lower case."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def subset_mask(term: Column) -> Column:
    """Bit k is set if the term is in subset k: if the last LEVELS[k] bits of a byte of an MD5 of the term are 0."""
    digest = F.concat(F.md5(term), F.md5(F.concat(F.lit("|"), term)))
    bits = [F.when(F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int") % (1 << level) == 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, level in enumerate(LEVELS)]
    return functools.reduce(lambda a, b: a + b, bits)


def lexicon(docs: DataFrame, low: float, high: float) -> DataFrame:
    """term and mask of the terms in more than `low` and at most `high` of the rows of `docs` (column text)."""
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.count()
    inside = (F.col("df").cast("double") > F.lit(low * n)) & (F.col("df").cast("double") <= F.lit(high * n))
    return counts.where(inside).select("term", subset_mask(F.col("term")).alias("mask"))


def with_hashes(df: DataFrame, found: str, fallback: str, out: str) -> DataFrame:
    """`df` and array `out`: the hash of all terms and of those of each subset ("" if it has none); without any term, the fallback's for all.

    `found` holds sorted (term, mask). Subsets of one level look only at the
    terms that some of them holds.
    """
    some = {level: sum(1 << k for k, x in enumerate(LEVELS) if x == level) for level in sorted(set(LEVELS))}
    split = df.withColumns({f"{out}_{level}": _having(found, bits) for level, bits in some.items()})
    one = lambda chosen: F.when(F.size(chosen) > 0, F.substring(F.md5(F.array_join(F.transform(chosen, lambda x: x["term"]), " ")), 1, 8)).otherwise(F.lit(""))
    parts = [one(F.col(found)), *[one(_having(f"{out}_{level}", 1 << k)) for k, level in enumerate(LEVELS)]]
    made = F.when(F.size(found) > 0, F.array(*parts)).otherwise(F.array_repeat(F.substring(F.col(fallback), 1, 8), 1 + SUBSETS))
    return split.withColumn(out, made).drop(*[f"{out}_{level}" for level in some])


def _having(found: str, bits: int) -> Column:
    return F.filter(found, lambda x: x["mask"].bitwiseAND(F.lit(bits).cast("bigint")) != 0)


def likeness(a: Column, b: Column) -> Column:
    """Of the hashes that aren't empty on both sides, the share that is equal."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.filter(both, lambda x: (x["a"] != "") | (x["b"] != ""))
    same = F.filter(used, lambda x: x["a"] == x["b"])
    return F.size(same).cast("double") / F.size(used)


def _bucket(ident: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the id, by binary search; 0 for a null id."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    arr = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    reach = lambda p, s: (p + s <= len(bounds)) & (F.element_at(arr, F.least(p + s, F.lit(len(bounds)))) <= ident)
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when(reach(p, s), p + s).otherwise(p))
    return F.when(ident.isNull(), F.lit(0)).otherwise(found)


def with_next(docs: DataFrame) -> DataFrame:
    """Columns bucket, at, last, id, text and next_text: the text of the next row in descending id, of the first after the last.

    Ranges of ids are dealt to tasks, and each gets the next range's first row
    as one more (last = 1), so no task sees the whole order. Equal ids are
    ordered by text; null ids come last.
    """
    spark = docs.sparkSession
    n = min(MAX_BUCKETS, 4 * partitions_for(spark))
    cuts = docs.agg(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), 20 * n).alias("c")).first()["c"]
    placed = docs.withColumn("bucket", _bucket(F.col("id"), sorted(set(cuts or []))))
    heads = sorted((r["bucket"], r["head"]) for r in placed.groupBy("bucket").agg(F.max("id").alias("head")).collect())  # MAX_BUCKETS rows at most
    pairs = [(heads[i][0], heads[i - 1][0], heads[i - 1][1]) for i in range(len(heads))]  # a bucket, and the next in descending order
    after = spark.createDataFrame(pairs, "to_bucket int, from_bucket int, head bigint")
    tie = Window.partitionBy("bucket").orderBy(F.asc_nulls_last("text"))
    extra = (
        placed.join(F.broadcast(after), (placed["bucket"] == after["from_bucket"]) & placed["id"].eqNullSafe(after["head"]))
        .select("id", "text", F.col("to_bucket").alias("bucket"))
        .withColumn("n", F.row_number().over(tie)).where("n = 1").select("id", "text", "bucket", F.lit(1).alias("last"))
    )
    every = placed.select("id", "text", "bucket", F.lit(0).alias("last")).unionByName(extra)
    order = Window.partitionBy("bucket").orderBy("last", F.desc_nulls_last("id"), F.asc_nulls_last("text"))
    return every.select("bucket", F.row_number().over(order).alias("at"), "last", "id", "text", F.lead("text").over(order).alias("next_text"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per row: id_col, n_chars, edited_sha256, hashes and edited_hashes (arrays), near_edited and near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by as
    many of the next row's first ones, in descending id (after the last comes
    the first); near_edited is the likeness of the text's hashes to the edited
    text's, near_next to the next row's. The lexicon comes from all rows; it
    is the texts' alone, not the edited ones'.

    Null texts are empty. A text without any lexicon term has the hash of the
    whole text in every place, so equal texts always have equal hashes. Rows
    with equal ids follow each other by text, null ids come last; every row
    gives one.
    """
    docs = df.select(column(df, id_col).cast("long").alias("id"), F.coalesce(column(df, text_col).cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.expr("substring(next_text, 1, length(text) div 2)"))
    rows = with_next(docs).select("bucket", "at", "last", "id", "text", F.when(F.col("last") == 0, edited).otherwise(F.lit("")).alias("edited"))
    kind = "struct<which:int,term:string,info:struct<last:int,id:bigint,n_chars:bigint,sha:string,whole:string,whole_edited:string>>"
    none = F.lit(None).cast("struct<last:int,id:bigint,n_chars:bigint,sha:string,whole:string,whole_edited:string>")
    info = F.struct("last", "id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), F.md5("text").alias("whole"), F.md5("edited").alias("whole_edited"))
    tag = lambda text, k: F.transform(terms(F.col(text)), lambda w: F.struct(F.lit(k).alias("which"), w.alias("term"), none.alias("info")))
    own = F.array(F.struct(F.lit(2).alias("which"), F.lit("").alias("term"), info.alias("info")))
    spread = rows.select("bucket", "at", F.explode(F.concat(own.cast(f"array<{kind}>"), tag("text", 0).cast(f"array<{kind}>"), tag("edited", 1).cast(f"array<{kind}>"))).alias("x")).select("bucket", "at", "x.*")
    words = written(lexicon(docs, low, high), "lexicon")
    if words.count() <= BROADCAST_TERMS:
        every = words.unionByName(df.sparkSession.createDataFrame([("", 0)], "term string, mask bigint"))  # "" is every row's own
        known = spread.join(F.broadcast(every), "term")
    else:
        known = spread.where("which < 2").join(words, "term").unionByName(spread.where("which = 2").withColumn("mask", F.lit(0).cast("bigint")))
    of = lambda k: F.collect_list(F.when(F.col("which") == k, F.struct("term", "mask")))
    met = known.groupBy("bucket", "at").agg(of(0).alias("found"), of(1).alias("found_edited"), F.max("info").alias("i"))
    flat = met.select("bucket", "at", "i.*", F.sort_array("found").alias("found"), F.sort_array("found_edited").alias("found_edited"))
    hashed = with_hashes(with_hashes(flat, "found", "whole", "hashes"), "found_edited", "whole_edited", "edited_hashes").drop("found", "found_edited")
    order = Window.partitionBy("bucket").orderBy("at")
    ahead = hashed.withColumn("next_hashes", F.lead("hashes").over(order)).where("last = 0")
    return ahead.select(F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), "hashes", "edited_hashes", likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))


def digest(df: DataFrame) -> DataFrame:
    """The hashes as strings."""
    return df.select("doc_id", "n_chars", "edited_sha256", F.array_join("hashes", "-").alias("fingerprint"), F.array_join("edited_hashes", "-").alias("edited_fingerprint"), "near_edited", "near_next")


_HASHES = """CASE WHEN len({l}) = 0 THEN list_transform(range(0, {m}), lambda k: substr(md5({t}), 1, 8))
       ELSE list_transform(range(-1, {m} - 1), lambda k: CASE WHEN len(list_filter({l}, lambda x: k < 0 OR (x.mask >> greatest(k, 0)) % 2 = 1)) = 0 THEN ''
         ELSE substr(md5(array_to_string(list_transform(list_filter({l}, lambda x: k < 0 OR (x.mask >> greatest(k, 0)) % 2 = 1), lambda x: x.term), ' ')), 1, 8) END) END"""

ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
         coalesce(lead(text) OVER w, first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id
  FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (
  SELECT doc_id, text, n, next_id, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM o),
words AS (
  SELECT doc_id, 0 AS which, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM e
  UNION ALL
  SELECT doc_id, 1, unnest(list_distinct(regexp_extract_all(lower(edited), '[\\p{{L}}\\p{{N}}]+'))) FROM e),
lexicon AS (
  SELECT term, list_sum(list_transform(range(0, {SUBSETS}), lambda k:
           CASE WHEN CAST('0x' || substr(md5(term) || md5('|' || term), CAST(2 * k + 1 AS INT), 2) AS INT) % (1 << {LEVELS}[CAST(k + 1 AS INT)]) = 0 THEN CAST(1 AS BIGINT) << k ELSE 0 END)) AS mask
  FROM words WHERE which = 0 GROUP BY term
  HAVING CAST(count(*) AS DOUBLE) > {LOW} * (SELECT count(*) FROM d) AND CAST(count(*) AS DOUBLE) <= {HIGH} * (SELECT count(*) FROM d)),
met AS (
  SELECT doc_id, which, list({{'term': term, 'mask': CAST(mask AS BIGINT)}} ORDER BY term) AS l
  FROM words JOIN lexicon USING (term) GROUP BY doc_id, which),
f AS (
  SELECT e.doc_id, n, next_id, edited, text, coalesce(a.l, []) AS la, coalesce(b.l, []) AS lb
  FROM e LEFT JOIN met a ON a.doc_id = e.doc_id AND a.which = 0 LEFT JOIN met b ON b.doc_id = e.doc_id AND b.which = 1),
h AS (
  SELECT doc_id, n, next_id, edited, {_HASHES.format(l="la", t="text", m=SUBSETS + 1)} AS ha, {_HASHES.format(l="lb", t="edited", m=SUBSETS + 1)} AS hb FROM f),
p AS (
  SELECT h.*, x.ha AS hn FROM h JOIN h x ON x.doc_id = h.next_id)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(ha, '-') AS fingerprint, array_to_string(hb, '-') AS edited_fingerprint,
  CAST(len(list_filter(range(1, {SUBSETS + 2}), lambda i: ha[i] <> '' AND ha[i] = hb[i])) AS DOUBLE) / len(list_filter(range(1, {SUBSETS + 2}), lambda i: ha[i] <> '' OR hb[i] <> '')) AS near_edited,
  CAST(len(list_filter(range(1, {SUBSETS + 2}), lambda i: ha[i] <> '' AND ha[i] = hn[i])) AS DOUBLE) / len(list_filter(range(1, {SUBSETS + 2}), lambda i: ha[i] <> '' OR hn[i] <> '')) AS near_next
FROM p
"""
