"""Exact top-k search by inner product with vector-approximation files.

The file: blocks of CANDIDATES vectors, each with a grid of CELLS cells between
the least and the greatest value of every component, and one byte a component
that says in which cell a vector lies. It is written once.

1. Scan: a task takes a group of queries and a chunk of blocks. From a vector's
   cells come a lower and an upper bound of its product with a query. Kept are
   the vectors whose upper bound reaches the kth lower bound, ties by id.
2. A query's kept vectors of all chunks meet, and the kth lower bound of all of
   them leaves the survivors. Only survivors' exact vectors move.
3. A query reads exact vectors in the order of their upper bounds until no
   unread bound reaches the kth exact score.

Rows of the scan are blocks, dealt on a grid of query groups and chunks, so no
key holds the table. Of equal vectors the 2k of least id are kept before, as
no others can be among the best; a crowd of copies costs no more than those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, delete_written, partitions_for, written

CELLS = 256
CANDIDATES = 2048  # vectors of a block
CHUNK = 1 << 16  # vectors that a task scans for a group
GROUP = 4096  # queries of a group
TILE = 512  # queries whose bounds are computed at once
ROUNDING = 2.0**-49  # of the products' magnitude and a component: more than sums of doubles go wrong by

CELLS_DDL = "dim int, n int, ids binary, cells binary, low binary, width binary"
BOUNDS_DDL = "at bigint, vec_id bigint, lower double, upper double"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double, at most 64 bits; null if the vector or a component is null or not finite."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(x.isNotNull() & finite, F.transform(x, lambda v: F.floor(v * 256.0).cast("long")))


def matrices(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) of a list column, for each number of components."""
    lens = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(lens) - lens
    for dim in np.unique(lens).tolist():
        rows = np.flatnonzero(lens == dim)
        yield rows, flat[start[rows][:, None] + np.arange(dim)].reshape(len(rows), dim)


def grid(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a block's vectors, and each component's least value and width of a cell. Differences are unsigned, so none overflows."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    width = (high.view(np.uint64) - low.view(np.uint64)) // np.uint64(CELLS) + np.uint64(1)
    return ((vectors.view(np.uint64) - low.view(np.uint64)) // width).astype(np.uint8), low, width


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's vectors, by their number of components, sorted by id."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(dim: int) -> pa.RecordBatch:
        ids, vectors = map(np.concatenate, zip(*held.pop(dim), strict=True))
        order = np.argsort(ids, kind="stable")
        cells, low, width = grid(np.ascontiguousarray(vectors[order]))
        row = (dim, len(ids), ids[order].astype("<i8").tobytes(), cells.tobytes(), low.astype("<i8").tobytes(), width.astype("<u8").tobytes())
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["dim", "n", "ids", "cells", "low", "width"])

    for batch in batches:
        ids = batch.column(0).to_numpy()
        for rows, vectors in matrices(batch.column(1)):
            dim = vectors.shape[1]
            for k in range(0, len(rows), CANDIDATES):
                held.setdefault(dim, []).append((ids[rows[k : k + CANDIDATES]], vectors[k : k + CANDIDATES]))
                if sum(len(i) for i, _ in held[dim]) >= CANDIDATES:
                    yield out(dim)
    for dim in list(held):
        yield out(dim)


def best_bounds(at: np.ndarray, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
    """Which bounds may belong to a query's k best: those not below k others for certain. Ties go to the smaller id."""
    order = np.lexsort((ids, -lower, at))
    own = at[order]
    start = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1]) if len(own) else np.empty(0, np.int64)
    size = np.diff(start, append=len(own))
    last = order[start + np.minimum(k, size) - 1]
    full = np.repeat(size >= k, size)
    least, id_ = np.repeat(lower[last], size), np.repeat(ids[last], size)
    keep = ~full | (upper[order] > least) | (upper[order] == least) & (ids[order] <= id_)
    return order[keep]


def block_bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The products of queries with the middles of vectors' cells, and how far each query's true products may be off."""
    span = width.astype(float)
    q = queries.astype(float)
    base = low.astype(float) + (span - 1) / 2
    middle = (q * span) @ cells.T.astype(float) + (q @ base)[:, None]
    largest = np.abs(low.astype(float)) + span * CELLS
    size = np.abs(q) @ largest
    off = np.abs(q) @ ((span - 1) / 2)
    inexact = size * max(1, q.shape[1]) >= 2.0**51  # below, all these sums are exact
    return middle, np.where(inexact, off + size * (q.shape[1] + 8) * ROUNDING, off)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of a batch in one row for each group and number of components."""
    for batch in batches:
        group, at, ids = (batch.column(i).to_numpy() for i in range(3))
        for rows, vectors in matrices(batch.column(3)):
            for g in np.unique(group[rows]).tolist():
                own = group[rows] == g
                row = (g, vectors.shape[1], at[rows[own]].astype("<i8").tobytes(), ids[rows[own]].astype("<i8").tobytes(), vectors[own].astype("<i8").tobytes())
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["group", "dim", "ats", "ids", "vectors"])


def _scan(k: int):
    """Bounds that may be among the k best of a group's queries in a chunk; a group's queries come before its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packs, asked, found = None, {}, {}, []

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                at, ids, lower, upper = map(np.concatenate, zip(*found, strict=True))
                keep = best_bounds(at, ids, lower, upper, k)
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (at, ids, lower, upper)], names=["at", "vec_id", "lower", "upper"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["group"], row["chunk"]) != key:
                    yield from flush()
                    key, packs, asked, found = (row["group"], row["chunk"]), {}, {}, []
                dim, ids = row["dim"], np.frombuffer(row["ids"], "<i8")
                if row["ats"] is not None:
                    packs.setdefault(dim, []).append((np.frombuffer(row["ats"], "<i8"), ids, np.frombuffer(row["vectors"], "<i8").reshape(len(ids), dim)))
                    continue
                if dim not in packs:
                    continue
                if dim not in asked:
                    asked[dim] = tuple(map(np.concatenate, zip(*packs[dim], strict=True)))
                ats, qids, queries = asked[dim]
                cells, low, width = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dim), np.frombuffer(row["low"], "<i8"), np.frombuffer(row["width"], "<u8")
                for t in range(0, len(ats), TILE):
                    middle, off = block_bounds(queries[t : t + TILE], low, width, cells)
                    middle[qids[t : t + TILE, None] == ids] = -np.inf  # a query's own id
                    take = min(k, len(ids))
                    kth = np.partition(middle, len(ids) - take, axis=1)[:, len(ids) - take]
                    q, v = np.nonzero((middle + 2 * off[:, None] >= kth[:, None]) & (middle > -np.inf))
                    m = middle[q, v]
                    own = ats[t : t + TILE][q], ids[v], m - off[q], m + off[q]
                    keep = best_bounds(*own, k)
                    found.append(tuple(x[keep] for x in own))
        yield from flush()

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a query ends; rows arrive sorted by `at`."""
    tail: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            at = batch["at"].to_numpy()
            last = int(np.searchsorted(at, at[-1], "left"))
            if tail and (last or tail[-1]["at"][-1].as_py() != at[0]):
                yield pa.Table.from_batches([*tail, batch.slice(0, last)])
                tail = []
            elif last:
                yield pa.Table.from_batches([batch.slice(0, last)])
            tail.append(batch.slice(last))
    if tail:
        yield pa.Table.from_batches(tail)


def _survivors(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            at, ids, lower, upper = (table[c].to_numpy() for c in ("at", "vec_id", "lower", "upper"))
            keep = best_bounds(at, ids, lower, upper, k)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (at, ids, upper)], names=["at", "vec_id", "upper"])

    return run


def products(query: np.ndarray, vectors: np.ndarray) -> list[int]:
    """Exact integer inner products, of any size."""
    if np.abs(query.astype(float)).max(initial=0) * np.abs(vectors.astype(float)).max(initial=0) * max(1, len(query)) < 2.0**62:
        return (vectors @ query).tolist()
    return [sum(a * b for a, b in zip(v, query.tolist(), strict=True)) for v in vectors.tolist()]


def read_in_order(query: np.ndarray, ids: np.ndarray, upper: np.ndarray, vectors: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best (id, score), and how many exact vectors were read to be certain; bounds fall from row to row."""
    got: list[tuple[int, int]] = []
    at, step = 0, 2 * k
    while at < len(ids) and not (len(got) == k and upper[at] < -got[-1][0]):  # a bound that only equals the kth may still win by its id
        scores = products(query, vectors[at : at + step])
        got = sorted([*got, *((-s, i) for s, i in zip(scores, ids[at : at + step].tolist(), strict=True))])[:k]
        at += step
    return [(i, -s) for s, i in got], min(at, len(ids))


def _exact(k: int):
    """The best of each query; its own row comes first, then its survivors' by falling bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            rows = table.combine_chunks().to_batches()[0]
            at, ids, upper = rows["at"].to_numpy(), rows["id"].to_numpy(), rows["upper"].to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]]).tolist()
            out = []
            for a, b in zip(start, start[1:], strict=False):
                if b > a + 1:
                    (_, all_), *_ = matrices(rows["v"].slice(a, b - a))  # survivors have as many components as the query
                    best, _ = read_in_order(all_[0], ids[a + 1 : b], upper[a + 1 : b], all_[1:], k)
                    out += [(int(ids[a]), r + 1, i, max(-(2**63) + 1, min(2**63 - 1, s))) for r, (i, s) in enumerate(best)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return run


def exact_top_k(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k vectors with the greatest integer inner product with each query.

    Components become floor(256 * x), at most 64 bits. Vectors that are null or
    hold null or non-finite components, and rows with a null id, take no part,
    as query or as candidate. Vectors of another number of components than the
    query's are no candidates; empty vectors score 0 with each other. A query's
    own id is no candidate. Ties go to the smaller id. Rows that repeat an id
    are candidates each, and queries each. Fewer than k candidates: all of
    them. Scores rank as whole numbers of any size; one beyond 64 bits is
    returned as the greatest or least number of 64 bits.
    """
    spark = vectors.sparkSession
    n = partitions_for(spark)
    shaped = lambda df: df.select(column(df, id_col).cast("long").alias("id"), quantised(column(df, vector_col)).alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    asked = written(shaped(queries).withColumn("at", F.monotonically_increasing_id()), "queries")
    once = F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    exact = written(shaped(vectors).withColumn("r", once).where(F.col("r") <= k).withColumn("r", least).where(F.col("r") <= 2 * k).select("id", "v"), "vectors")
    file = written(exact.mapInArrow(_file, CELLS_DDL), "cells")
    groups = max(1, -(-asked.count() // GROUP))
    size = file.agg(F.sum("n"), F.count(F.lit(1))).first()
    chunks = max(1, -(-(size[0] or 0) // CHUNK), min(n, size[1]))
    packs = asked.select(F.pmod("at", F.lit(groups)).alias("group"), "at", "id", "v").repartition(min(n, groups), "group").sortWithinPartitions("group").mapInArrow(_packs, "group bigint, dim int, ats binary, ids binary, vectors binary")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    none = F.lit(None).cast("binary")
    left = packs.withColumn("chunk", every(chunks)).select(F.col("group").cast("int").alias("group"), "chunk", "dim", "ids", "ats", "vectors", none.alias("cells"), none.alias("low"), none.alias("width"))
    right = file.withColumn("chunk", F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).cast("int")).withColumn("group", every(groups)).select("group", "chunk", "dim", "ids", none.alias("ats"), none.alias("vectors"), "cells", "low", "width")
    tiles = left.union(right).repartition(max(n, min(4 * n, groups * chunks)), "group", "chunk").sortWithinPartitions("group", "chunk", F.col("ats").isNull())
    bounds = tiles.mapInArrow(_scan(k), BOUNDS_DDL).repartition(n, "at").sortWithinPartitions("at")
    survivors = bounds.mapInArrow(_survivors(k), "at bigint, vec_id bigint, upper double").distinct()
    read = survivors.join(exact, survivors["vec_id"] == exact["id"]).select("at", "id", "upper", "v")
    heads = asked.select("at", "id", F.lit(float("inf")).alias("upper"), "v")
    met = heads.withColumn("kind", F.lit(0)).union(read.withColumn("kind", F.lit(1)))
    best = met.repartition(n, "at").sortWithinPartitions("at", "kind", F.desc("upper"), "id").drop("kind").mapInArrow(_exact(k), "query_id bigint, rank int, vec_id bigint, score bigint")
    result = written(best, "best")
    delete_written(asked, exact, file)
    return result


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
