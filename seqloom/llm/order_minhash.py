"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's shingles of SHINGLE words are labelled with their occurrence number.
Each of ORDERS random orders of the labelled shingles takes the LEAST least
ones and keeps the order in which the text has them. Every two of them, in that
order, make a band value: equal values are likely only if the texts agree in
content and in order, that is, in edit distance. Taking all pairs of four
minima finds more than as many orders of two: at a shingle resemblance of 0.2,
which a fifth of scattered words leaves, an order brings a pair together with
probability 0.35, sixteen of them nearly always (measured: 0.96 of pairs of 60
words with a fifth replaced, 0.99 of 200 words, all with a sixth replaced).

Texts of up to SHORT words have SHORT_ORDERS values of one least shingle of two
words instead, in which similar texts of any length agree almost surely, as few
of their five-word shingles outlive an edit; texts whose partners may lie on
either side have both.

1. Exact copies fold into the least id.
2. Texts with an equal band value are candidates, unless their lengths differ
   by more than the similarity allows. A bucket of FEW texts sends all its pairs.
   Larger buckets send none: those whose least id is the same, as a common
   passage makes them, are one crowd. A crowd is cut into classes of length, in
   which and next to which all similar texts lie, and classes into blocks, whose
   texts meet with their words, each pair of blocks in one place. There each
   pair is ruled out by the number of words in common (a word that the longer
   has alone costs an edit), or connected by links proven before, or aligned.
   So a crowd of copies costs a link a text, and unlike texts with a common
   passage cost comparisons but no rows.
3. Candidates are aligned word by word in a band as wide as the similarity
   allows (1 - edits / words of the longer >= 0.8): at first along the words
   that both texts have once, which proves most links; where that doesn't, by
   the exact banded distance.
4. Verified links make classes, as connected components.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom_of, bloom_positions, bloom_test
from .common import column, dealt_anew, delete_written, id_text, partitions_for, written
from .components import components

SHINGLE, LEAST, ORDERS = 5, 4, 16
SHORT, SHORT_ORDERS = 40, 32
SIMILAR = 0.8
CLASS = 1.26  # lengths of similar texts differ by a quarter at most, and so lie in one class or in two neighbouring ones
FEW = 8  # texts of a bucket that sends all its pairs
BLOCK, BLOCK_WORDS = 1000, 2_000_000  # texts of a crowd's block, and their words
WIDE = 200_000  # shingles times bands at once
PER_TASK = 500  # texts aligned with one copy of a leader
CACHE = 150_000

_rng = np.random.default_rng(20_240_501)
FACTORS = _rng.integers(1, 1 << 62, max(ORDERS, SHORT_ORDERS), np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(0, 1 << 62, max(ORDERS, SHORT_ORDERS), np.uint64)
POLY = _rng.integers(1, 1 << 62, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
JOIN = _rng.integers(1, 1 << 62, 2, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


class WordIds(dict):
    """64-bit hashes of words, kept for those seen lately."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def labelled(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles, each with its occurrence number; a shorter text is one shingle."""
    n = max(1, len(words) - shingle + 1)
    k = min(shingle, len(words))
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * POLY[j]
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(n)
    nth = np.empty(n, np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return mixed(h + nth * np.uint64(0x9E3779B97F4A7C15))


def order_sketch(words: np.ndarray, shingle: int = SHINGLE, least: int = LEAST, orders: int = ORDERS) -> np.ndarray:
    """The values of each order: hashes of every two of its `least` least labelled shingles, in text order; of the one, if there is but one."""
    h = labelled(words, shingle)
    n, take = len(h), min(least, len(h))
    first, second = np.triu_indices(take, 1)
    out = np.empty((orders, max(1, len(first))), np.uint64)
    step = max(1, WIDE // n)
    for b in range(0, orders, step):
        v = (h[None, :] ^ MASKS[b : min(b + step, orders), None]) * FACTORS[b : min(b + step, orders), None]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0x81DADEF4BC2DD44D)
        own = h[np.sort(np.argpartition(v, take - 1, axis=1)[:, :take], axis=1)]
        out[b : b + step] = own[:, first] * JOIN[0] + own[:, second] * JOIN[1] if take > 1 else own * JOIN[0]
    return mixed(out + np.arange(orders, dtype=np.uint64)[:, None]).ravel()


def band_values(words: np.ndarray) -> np.ndarray:
    """The values by which a text meets others: similar ones of at most SHORT / SIMILAR words in short bands, others in long ones."""
    short = [mixed(order_sketch(words, 2, 1, SHORT_ORDERS))] if len(words) <= SHORT / SIMILAR else []
    return np.concatenate([*short, *([order_sketch(words)] if len(words) > SHORT else [])])


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The edit distance of two sequences if it is `limit` or less, by bit vectors over the band of diagonals.

    A column's vertical differences within `limit` of the main diagonal stand
    in two integers, which slide down by one row a column. Memory is that of a
    few integers of len(a) bits, whatever the distance.
    """
    n, m = len(a), len(b)
    if abs(m - n) > limit:
        return None
    where: dict[int, int] = {}
    words = a.tolist()
    if limit >= min(n, m):  # the band holds everything
        for i, w in enumerate(words):
            where[w] = where.get(w, 0) | 1 << i
        full, up, down, d = (1 << n) - 1, (1 << n) - 1, 0, n
        if not n:
            return m
        for w in b.tolist():
            x = where.get(w, 0)
            zero = (((x & up) + up) ^ up) | x | down
            right, left = down | ~(zero | up) & full, zero & up
            d += (right >> n - 1 & 1) - (left >> n - 1 & 1)
            right = (right << 1 | 1) & full
            up, down = (left << 1 | ~(zero | right)) & full, right & zero
        return d if d <= limit else None
    size = 2 * limit + 2
    full, top = (1 << size) - 1, size - 1
    for i, w in enumerate(words):
        where[w] = where.get(w, 0) | 1 << (i + size)  # so that every window is a shift to the right
    up, down, d = full & ~((1 << top - limit) - 1), 0, limit
    most = 2 * limit + m - n
    at = top - 1
    for j, w in enumerate(b.tolist()):
        x = where.get(w, 0) >> (j + limit + 1) & full
        zero = ((((x & up) + up) ^ up) | x | down) & full
        right, left = (down | ~(zero | up)) & full, zero & up
        if j < n - limit:
            d += not zero >> top & 1
            if d > most:
                return None
        else:
            d += (right >> at & 1) - (left >> at & 1)
            at -= 1
        zero >>= 1
        up, down = (left | ~(zero | right)) & full, zero & right
    return d if d <= limit else None


def _chain(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest part of the points (i rising) in which j rises too."""
    if (np.diff(j) > 0).all():
        return i, j
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(j)
    for k, v in enumerate(j.tolist()):
        p = bisect_left(tails, v)
        tails[p:] = [v, *tails[p + 1 :]] if p < len(tails) else [v]
        back[k] = at[p - 1] if p else -1
        at[p:] = [k, *at[p + 1 :]] if p < len(at) else [k]
    keep, k = [], at[-1]
    while k >= 0:
        keep.append(k)
        k = back[k]
    own = np.array(keep[::-1])
    return i[own], j[own]


def anchored_edits(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> int:
    """Edits of an alignment through the points (i, j), never fewer than the distance: gaps of equal length are compared word by word."""
    i, j = _chain(i, j)
    i, j = np.concatenate([[-1], i, [len(a)]]), np.concatenate([[-1], j, [len(b)]])
    ga, gb = np.diff(i) - 1, np.diff(j) - 1
    even = (ga == gb) & (ga > 0)
    edits = int(np.maximum(ga, gb)[~even].sum())
    if even.any():
        n, from_a, from_b = ga[even], i[:-1][even] + 1, j[:-1][even] + 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        edits += int((a[np.repeat(from_a, n) + step] != b[np.repeat(from_b, n) + step]).sum())
    return edits


class Text:
    """A text's word hashes, and its distinct ones with their first places and counts."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.distinct, self.first, self.counts = np.unique(words, return_index=True, return_counts=True)


def similar(x: Text, y: Text, least: float = SIMILAR) -> float | None:
    """1 - edits / words of the longer, if an alignment with that of `least` or more exists (not always the best one's)."""
    a, b = x.words, y.words
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    limit = int(np.floor((1 - least) * longer + 1e-9))
    if abs(len(a) - len(b)) > limit:
        return None
    _, ia, ib = np.intersect1d(x.distinct, y.distinct, assume_unique=True, return_indices=True)
    ca, cb = x.counts[ia], y.counts[ib]
    if longer - int(np.minimum(ca, cb).sum()) > limit:  # words that the other lacks cost an edit each
        return None
    once = (ca == 1) & (cb == 1)
    i, j = x.first[ia[once]], y.first[ib[once]]
    inside = np.abs(i - j) <= limit
    order = np.argsort(i[inside])
    d = anchored_edits(a, b, i[inside][order], j[inside][order])
    if d > limit:
        d = banded_distance(a, b, limit)
    return None if d is None else 1 - d / longer


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = WordIds()
    for batch in batches:
        digest, n, sketch = [], [], []
        for t in batch.column(1):
            text = t.as_py() or ""
            words = ids.of(text)
            digest.append(xxhash.xxh3_128_digest(text))
            n.append(len(words))
            sketch.append(band_values(words).astype("<u8").tobytes() if len(words) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(sketch, pa.binary())], names=["id", "digest", "n", "sketch"])


BAND = "key bigint, id bigint, n int"
MET = "lead bigint, id bigint, crowd bigint, n int"
MET_SCHEMA = pa.schema([("lead", pa.int64()), ("id", pa.int64()), ("crowd", pa.int64()), ("n", pa.int32())])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct band value of a text."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            values = [np.unique(np.frombuffer(s, "<i8")) for s in part.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), part.column(0).take(at), part.column(1).take(at)], names=["key", "id", "n"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a key ends; rows arrive sorted by key."""
    tail: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if tail and (last or tail[-1].column("key")[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*tail, batch.slice(0, last)])
            tail = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        tail.append(batch.slice(last))
    if tail:
        yield pa.Table.from_batches(tail)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    return start, np.diff(start, append=len(key))


def _of_large(batch: pa.RecordBatch, crowd: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch["id"], pa.array(crowd, pa.int64()), batch["n"]], schema=MET_SCHEMA)


def _of_small(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Whole buckets: pairs of those of FEW texts that lengths allow, the rows of others with their least id."""
    key, ids, n = rows["key"].to_numpy(), rows["id"].to_numpy(), rows["n"].to_numpy()
    start, each = _runs(key)
    size = np.repeat(each, each)
    at = np.flatnonzero((size > 1) & (size <= FEW))
    k = key[at]
    for step in range(1, min(FEW, len(at))):
        i = np.flatnonzero(k[step:] == k[:-step])
        if not len(i):
            break
        a, b = at[i], at[i + step]
        ok = np.abs(n[a] - n[b]) <= np.floor((1 - SIMILAR) * np.maximum(n[a], n[b]) + 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]]), pa.nulls(ok.sum(), pa.int64()), pa.nulls(ok.sum(), pa.int32())], schema=MET_SCHEMA)
    if (size > FEW).any():
        yield _of_large(rows.filter(pa.array(size > FEW)), np.repeat(ids[start], each)[size > FEW])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of small buckets, rows of large ones with their least id. Rows arrive sorted by key and id; no more than a batch and FEW of them are held."""
    tail: list[pa.RecordBatch] = []
    crowded, crowd = None, 0  # the key of a large bucket whose rows go on, and its least id
    for batch in batches:
        if crowded is not None:
            more = int(np.searchsorted(batch["key"].to_numpy(), crowded, "right"))
            yield _of_large(batch.slice(0, more), np.full(more, crowd))
            batch = batch.slice(more)
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*tail, batch]).combine_chunks().to_batches()[0]
        key = rows["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield from _of_small(rows.slice(0, last))
        tail, crowded = [rows.slice(last)], None
        if len(rows) - last > FEW:
            crowded, crowd = key[-1], tail[0]["id"][0].as_py()
            yield _of_large(tail[0], np.full(len(rows) - last, crowd))
            tail = []
    if tail:
        yield from _of_small(tail[0])


def _counted(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of texts by small numbers, how often each stands in its text, and where each text's begin."""
    _, code = np.unique(np.concatenate(words), return_inverse=True)
    size = int(code.max()) + 1
    each, counts = np.unique(np.repeat(np.arange(len(words)), [len(w) for w in words]) * size + code, return_counts=True)
    return each % size, counts, np.searchsorted(each // size, np.arange(len(words) + 1))


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect all similar texts of two blocks, or of one with itself (side 0), as far as these pairs do."""
    for table in _buckets(batches):
        start, size = _runs(table["key"].to_numpy())
        for c, s in zip(start.tolist(), size.tolist(), strict=True):
            own = table.slice(c, s)
            words = [np.frombuffer(x, "<u4") for x in own["words"].to_pylist()]
            n = np.fromiter(map(len, words), np.int64, s)
            order = np.lexsort((own["id"].to_numpy(), n))
            n, ids, side, words = n[order], own["id"].to_numpy()[order], own["side"].to_numpy()[order], [words[i] for i in order]
            codes, counts, at = _counted(words)
            count_of = np.zeros(codes.max() + 1, np.int64)
            texts: dict[int, Text] = {}
            text = lambda i: texts.get(i) or texts.setdefault(i, Text(words[i]))  # noqa: E731, B023
            part = np.arange(s)  # the number of each text's component
            a, b, found = [], [], []
            for i in range(1, s):
                low = int(np.searchsorted(n[:i], n[i] * SIMILAR - 1))
                if low == i:
                    continue
                own_codes, upto = codes[at[i] : at[i + 1]], at[low]
                count_of[own_codes] = counts[at[i] : at[i + 1]]
                common = np.add.reduceat(np.minimum(count_of[codes[upto : at[i]]], counts[upto : at[i]]), at[low:i] - upto)
                count_of[own_codes] = 0
                ok = (n[i] - common <= int((1 - SIMILAR) * n[i] + 1e-9)) & ((side[low:i] != side[i]) | (side[i] == 0))
                j = low + np.flatnonzero(ok)
                for k in j[np.argsort(part[j], kind="stable")].tolist():
                    if part[k] != part[i] and (alike := similar(text(k), text(i))) is not None:
                        part[part == part[i]] = part[k]
                        a.append(ids[k])
                        b.append(ids[i])
                        found.append(alike)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found, pa.float64())], names=["a", "b", "similarity"])


def _words(shared, bits: int):
    """Word hashes of the texts whose id the Bloom filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        ids = WordIds()
        for batch in batches:
            at = np.flatnonzero(bloom_test(wanted, bloom_positions(batch.column(0).to_numpy(), bits)))
            for k in range(0, len(at), 500):
                part = batch.take(pa.array(at[k : k + 500]))
                words = [(ids.of(t.as_py() or "") >> np.uint64(32)).astype("<u4").tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.binary())], names=["doc", "words"])

    return run


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between leaders and texts that are similar; a leader's row comes before its texts'."""
    lead, words = None, None
    for batch in batches:
        a, b, s = [], [], []
        for at, salt, doc, first, packed in zip(*batch.columns, strict=True):
            at, salt, own = at.as_py(), salt.as_py(), Text(np.frombuffer(packed.as_py(), "<u4"))
            if first.as_py():
                lead, words = (at, salt), own
            elif (at, salt) == lead and (found := similar(words, own)) is not None:
                a.append(at)
                b.append(doc.as_py())
                s.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])


def _pairs(met: DataFrame) -> DataFrame:
    return met.where("lead <> id").select(F.least("lead", "id").alias("lead"), F.greatest("lead", "id").alias("id")).distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc and words of the texts whose id is in `ids`, and of a few others."""
    wanted, bits = bloom_of(ids)
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(wanted.tobytes(), 1))
    return docs.select("id", "text").mapInArrow(_words(shared, bits), "doc bigint, words binary")


LINK = "a bigint, b bigint, similarity double"


def _aligned(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, similarity of those of the pairs (lead, id) that are similar; PER_TASK of them meet with one copy of the leader's words."""
    shares = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).alias("shares")).select(dealt_anew("lead"), "shares")
    members = pairs.join(shares, "lead").select("lead", F.pmod(F.xxhash64("id"), F.col("shares")).alias("salt"), F.col("id").alias("doc"))
    heads = members.select("lead", "salt").distinct().select("lead", "salt", F.col("lead").alias("doc"))
    routes = heads.withColumn("first", F.lit(True)).union(members.withColumn("first", F.lit(False)))
    texts = _texts(docs, pairs.select(F.explode(F.array("lead", "id")).alias("id")).distinct())
    sent = routes.join(texts, "doc").select("lead", "salt", "doc", "first", "words")
    return sent.repartition(partitions_for(docs.sparkSession), "lead", "salt").sortWithinPartitions("lead", "salt", F.desc("first")).mapInArrow(_align, LINK)


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (crowd, id, n) with their class of length, their block in it, and how many blocks their class and the two beside it have."""
    classed = rows.withColumn("class", F.floor(F.log(CLASS, F.col("n"))).cast("int"))
    many = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_WORDS)
    sizes = classed.groupBy("crowd", "class").agg(F.ceil(many).cast("int").alias("blocks"))
    beside = lambda step, name: sizes.select("crowd", (F.col("class") + step).alias("class"), F.col("blocks").alias(name))
    around = sizes.join(beside(1, "below"), ["crowd", "class"], "left").join(beside(-1, "above"), ["crowd", "class"], "left").na.fill(0, ["below", "above"])
    sized = classed.join(around.select(dealt_anew("crowd"), "class", "blocks", "below", "above"), ["crowd", "class"])
    return sized.withColumn("block", F.pmod(F.xxhash64("id", "crowd"), F.col("blocks")).cast("int"))


def _met_blocks(rows: DataFrame) -> DataFrame:
    """A row for each pair of blocks that a text's block takes part in, under the pair's key; side 0 is a block with itself."""
    pair = lambda k, a, l, b, side: F.struct(F.xxhash64("crowd", k, a, l, b).alias("key"), F.lit(side).alias("side"))
    own, block = F.col("class"), F.col("block")
    steps = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    each = F.concat(
        F.transform(steps(F.lit(0), block - 1), lambda v: pair(own, v, own, block, 2)),
        F.array(pair(own, block, own, block, 0)),
        F.transform(steps(block + 1, F.col("blocks") - 1), lambda v: pair(own, block, own, v, 1)),
        F.transform(steps(F.lit(0), F.col("above") - 1), lambda v: pair(own, block, own + 1, v, 1)),
        F.transform(steps(F.lit(0), F.col("below") - 1), lambda v: pair(own - 1, v, own, block, 2)),
    )
    return rows.select(F.explode(each).alias("x"), "id").select("x.key", "x.side", "id")


def near_links(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b, similarity of verified links between different texts; ids stand for all their exact copies.

    Every pair that meets in a band is verified, or verified links connect it.
    """
    n = partitions_for(docs.sparkSession)
    dealt = lambda df, *then: df.repartition(n, "key").sortWithinPartitions("key", *then)
    distinct = sketches.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "sketch")).alias("x")).select("x.*")
    met = written(dealt(distinct.mapInArrow(_bands, BAND), "id").mapInArrow(_meet, MET), "met")
    pairs = written(_pairs(met.where("lead is not null").select("lead", "id")), "pairs")
    links = written(_aligned(docs, pairs), "near")
    large = met.where("crowd is not null").select("crowd", "id", "n")
    if not large.isEmpty():
        rows = written(large.distinct(), "crowds")
        sent = _met_blocks(_blocked(rows)).join(_texts(docs, rows.select("id").distinct()), F.col("id") == F.col("doc")).select("key", "side", "id", "words")
        links = links.union(written(dealt(sent).mapInArrow(_prove, LINK), "near"))
        delete_written(rows)
    delete_written(met, pairs)
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and class_id, the least id of the row's class, for each row of `df`.

    Classes are the connected components of exact copies and of links with a
    word similarity of 0.8 or more. A null text is an empty one; texts without
    words are alike only if equal. Rows that repeat an id get one class, that
    of all its texts. Rows with a null id are in no class: class_id is null.
    """
    every = id_text(df, id_col, text_col)
    sketches = written(every.where("id is not null").mapInArrow(_sketch, "id bigint, digest binary, n int, sketch binary"), "sketches")
    links = near_links(every.where("id is not null"), sketches).select("a", "b")
    own = written(sketches.groupBy("digest").agg(F.min("id").alias("rep")), "copies")
    copies = sketches.select("id", "digest").join(own, "digest").select("id", "rep")
    doubled = sketches.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("id")
    if not doubled.isEmpty():  # ids of several texts
        links = links.union(copies.join(doubled, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    roots = components(links)
    classes = copies.groupBy("id").agg(F.min("rep").alias("rep")).join(roots, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("root", "rep").alias("class_id"))
    ids = df.select(column(df, id_col).cast("long").alias(id_col))
    known = ids.join(classes, ids[id_col].eqNullSafe(classes["id"]), "left")
    return known.select(id_col, "class_id")
