"""Line deduplication: two Bloom filters name the suspects, an exact count confirms them.

Each task notes the hashes of its documents' lines in two Bloom filters, seen
once and seen again. The filters of all tasks are merged by segments (what two
tasks have both seen once is seen again). Only lines that the merged second
filter suspects are shuffled, as text, to count their documents exactly and to
choose the one that keeps them. A Bloom filter has no false negatives, so no
repeat is missed, and false positives fall out in the exact count: the result
doesn't depend on the filters' size. The size follows the number of lines up
to MAX_BITS a filter, which bounds what is sent to the driver and broadcast;
beyond it more lines are suspected and shuffled, and the result stays exact.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_names, partitions_for, pieces, written

BLANK = " \t\n\x0b\x0c\r"
PROBES = 4
MIN_BITS, MAX_BITS = 16, 28  # powers of two
BITS_A_LINE = 10
SEGMENT = 17  # bytes, as a power of two
STEP = 2 << 20


def line_key(line: str) -> str:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = line.strip(BLANK)
    return bare.lower() if bare.isascii() else bare.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def long_keys(text: str | None, least: int) -> set[str]:
    return {k for line in (text or "").split("\n") if len(line) >= least and len(k := line_key(line)) >= least}


def positions(keys: list[str], bits: int) -> np.ndarray:
    """PROBES bit positions of each key, by double hashing."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64((1 << bits) - 1)).astype(np.int64)


def test(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def mark(filter_: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(filter_, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _segments(once: np.ndarray, again: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    size = min(len(once), 1 << SEGMENT)
    for s in range(len(once) // size):
        o, a = once[s * size : (s + 1) * size], again[s * size : (s + 1) * size]
        if o.any():
            yield s, zlib.compress(o.tobytes(), 1), zlib.compress(a.tobytes(), 1)


PARTS = pa.schema([("segment", pa.int32()), ("task", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])
PARTS_DDL = "segment int, task int, once binary, again binary"


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(PARTS)], schema=PARTS)


def _fill(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, again = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)
        task = TaskContext.get().partitionId()

        def note(keys: list[str]) -> None:
            at = positions(keys, bits)
            _, first, n = np.unique(at, axis=0, return_index=True, return_counts=True) if len(at) else (None, np.empty(0, int), np.empty(0, int))
            one = at[first]
            mark(again, one[(n > 1) | test(once, one)])
            mark(once, one)

        held: list[str] = []
        for batch in batches:
            for t in batch.column(0):
                held += long_keys(t.as_py(), least)
                if len(held) > 20_000:
                    note(held)
                    held = []
        if held:
            note(held)
        for part in _segments(once, again):
            yield _parts([(part[0], task, *part[1:])])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for s, _, o, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            o, a = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, a))
            if s in got:
                once, again = got[s]
                got[s] = once | o, again | a | (once & o)
            else:
                got[s] = o, a
    for s, (once, again) in got.items():
        yield _parts([(s, 0, zlib.compress(once.tobytes(), 1), zlib.compress(again.tobytes(), 1))])


def seen_again(df: DataFrame, text: str, least: int) -> tuple[np.ndarray, int]:
    """The merged filter of keys in two or more rows of column `text`, and the power of two of its bits."""
    spark = df.sparkSession
    lines = df.agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(BITS_A_LINE * lines + 1))))
    n = partitions_for(spark)
    parts = df.select(text).mapInArrow(_fill(bits, least), PARTS_DDL)
    fan = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    some = parts.repartition(n, "segment", F.col("task") % fan).mapInArrow(_merge, PARTS_DDL)
    whole = some.repartition(n, "segment").mapInArrow(_merge, PARTS_DDL).select("segment", "again")
    size = min(1 << (bits - 3), 1 << SEGMENT)
    again = np.zeros(1 << (bits - 3), np.uint8)
    for s, x in whole.collect():  # MAX_BITS bounds it
        again[s * size : (s + 1) * size] = np.frombuffer(zlib.decompress(x), np.uint8)
    return again, bits


def _suspects(shared, bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        for batch in batches:
            keys: list[str] = []
            ids: list[int | None] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = long_keys(t.as_py(), least)
                keys += own
                ids += [i] * len(own)
            if keys:
                hit = np.flatnonzero(test(again, positions(keys, bits))).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hit], pa.int64()), pa.array([keys[i] for i in hit], pa.string())], names=["id", "key"])

    return run


def _drop(names: list[str], text: int):
    """Rows without their lines of the keys in the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch, text, STEP):
                part = batch.slice(a, b - a)
                kept, n, d = [], [], []
                for t, keys in zip(part.column(text), part.column(0), strict=True):
                    lines = (t.as_py() or "").split("\n")
                    keys = keys.as_py()
                    left = lines
                    if keys:
                        gone = set(keys)
                        left = [x for x in lines if line_key(x) not in gone]
                    kept.append("\n".join(left))
                    n.append(len(lines))
                    d.append(len(lines) - len(left))
                cols = [pa.array(kept, pa.string()) if k == text else c for k, c in enumerate(part.columns)][1:]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=names)

    return run


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """`df` with repeated lines taken out of its texts, and columns n_lines (before) and n_dropped.

    A line's key is the line without the blanks [\\x20\\x09-\\x0D] at its ends,
    A-Z in lower case. Keys of `least_chars` code points or more that
    `least_docs` ids or more hold lose all their lines, except in the largest
    id that holds them, which keeps all of its own. Other lines stay.

    Null and empty texts are one empty line and come out empty. Rows that
    repeat an id are one document: what it keeps or loses holds for each. A
    null id counts as one document, smaller than all others. n_lines and
    n_dropped get leading underscores where `df` has such columns already.
    """
    spark = df.sparkSession
    lines, dropped, gone, ref = free_names(df, "n_lines", "n_dropped", "__gone", "__ref")
    narrow = df.select(column(df, id_col).cast("long").alias("id"), column(df, text_col).cast("string").alias("text"))
    again, bits = seen_again(narrow, "text", least_chars)
    shared = spark.sparkContext.broadcast(zlib.compress(again.tobytes(), 1))
    suspects = written(narrow.mapInArrow(_suspects(shared, bits, least_chars), "id bigint, key string"), "suspects")
    repeated = written(
        suspects.groupBy("key", "id").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count("one").alias("docs"), F.max("id").alias("keeper"))
        .where(F.col("docs") >= least_docs).select("key", "keeper"),
        "repeated",
    )
    lost = suspects.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy(F.col("id").alias(ref)).agg(F.collect_set("key").alias(gone))
    at = df.columns.index(text_col)
    plain = df.select(*[column(df, c).cast("string").alias(f"c{k}") if k == at else column(df, c).alias(f"c{k}") for k, c in enumerate(df.columns)])
    joined = plain.join(lost, plain[f"c{df.columns.index(id_col)}"].cast("long").eqNullSafe(lost[ref]), "left").select(lost[gone], *[plain[c] for c in plain.columns])
    fields = [T.StructField(f.name, T.StringType()) if k == at else f for k, f in enumerate(df.schema.fields)]
    schema = T.StructType([*fields, T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())])
    return joined.mapInArrow(_drop(schema.names, at + 1), schema)


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
