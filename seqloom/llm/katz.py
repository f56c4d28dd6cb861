"""Katz backoff language model over words: Good-Turing discounts, exact backoff weights.

Counts live in tables partitioned by word and, for each order, by context in the
shared folder. Documents stand in blocks of a few MB. A block sends every
distinct word, then order by order every distinct n-gram, once to the partition
that counts it, and gets the corpus's counts back in the order sent; so what
moves is packed distinct n-grams, and no task and no driver ever holds the whole
model. Words have corpus-wide numbers, and an n-gram is known by its words'
numbers: no hash stands for one.

    P(w | h) = d(c(h w)) c(h w) / c(h)   if h w was seen; h is up to order - 1 words, h' all but its first
             = alpha(h) P(w | h')        otherwise, alpha(h) = 1 for an unseen h
    P(w)     = d(c(w)) c(w) / N          if w was seen
             = what is left, as one class of unknown words, otherwise

d is the Good-Turing discount of its order for counts up to LOW, 1 above.
alpha(h) is exactly what the seen words leave over their share of P( | h'). As
the suffix of a seen n-gram was seen, that share needs no more than the
suffixes' counts: a block sends them along. A text is its words and one end; the
end also stands in every place of a context before the first word.

Frequent contexts are split over as many partitions as their share of the
corpus asks for; their partial sums (no more of them than partitions) meet
before they are used.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, delete_written, partitions_for, written

BLOCK = 5 << 20  # bytes of text
PART = 8 << 20  # bytes of text for each partition of the n-gram tables
LOW = 5  # counts up to here are discounted
END = b"\n"  # no word holds a blank
ORDER = 2  # words of the longest n-grams
SPREAD = 4  # a context of this many partitions' mean share or more is split

ROWS = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
ROWS_DDL = "kind int, part bigint, block bigint, data binary"
STATS, DOCS, WORDS, COUNTS, GRAMS, HOT, FOUND = range(7)  # FOUND is that of order 2, and so on


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in compressed byte planes: high bytes of small numbers cost nothing."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T) if len(a) else np.empty(0, np.uint8)
        out.append((a.dtype.str, len(a), pa.compress(planes.tobytes(), "zstd", asbytes=True)))
    return pickle.dumps(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, packed in pickle.loads(data):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(pa.decompress(packed, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
    return out


def rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t.type) for i, t in enumerate(ROWS)], schema=ROWS)


def grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[tuple[int, int, int, bytes]]]]:
    """(key, its rows) of rows sorted by the key."""
    key, held = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = r[1] if by == "part" else r[2]
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(r)
    if held:
        yield key, held


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _blocks(parts: int):
    """A DOCS row for each block, and its distinct words with their training counts for each partition."""

    def block(number: int, docs: list[tuple]) -> pa.RecordBatch:
        local = Ids()
        local[END] = 0
        get = local.__getitem__
        tokens, lens = [], []
        for _, _, text in docs:
            words = text.encode().lower().split()
            tokens.append(np.fromiter(map(get, words), np.uint32, len(words)))
            tokens.append(np.zeros(1, np.uint32))
            lens.append(len(words) + 1)
        flat, lens = np.concatenate(tokens), np.array(lens, np.int32)
        held = np.array([h for _, h, _ in docs], np.uint8)
        digests = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in local), np.uint64, len(local))
        rank = np.argsort(-np.bincount(flat, minlength=len(local)), kind="stable")  # frequent words get small numbers, which pack well
        place = np.empty(len(rank), np.uint32)
        place[rank] = np.arange(len(rank))
        flat, digests = place[flat], digests[rank]
        train = np.bincount(flat[np.repeat(held == 0, lens)], minlength=len(rank)).astype(np.int32)
        part = (digests % np.uint64(parts)).astype(np.uint32)
        ids = np.array([i or 0 for i, _, _ in docs], np.int64)
        known = np.array([i is not None for i, _, _ in docs], np.uint8)
        out = [(DOCS, -1, number, pack(ids, known, held, lens, flat, part, place[:1]))]
        order = np.argsort(part, kind="stable")
        for p, at in _runs(part[order]):
            own = order[at]
            out.append((WORDS, p, number, pack(digests[own], train[own])))
        return rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i, h, t in zip(*batch.columns, strict=True):
                text = t.as_py() or ""
                held.append((i.as_py(), bool(h.as_py()), text))
                size += len(text) + 1
                if size >= BLOCK:
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(number, held)

    return run


def _runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, its slice) of a sorted array."""
    if len(values):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]).tolist()
        for a, b in zip(cut, cut[1:], strict=False):
            yield int(values[a]), slice(a, b)


def counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, LOW + 2), minlength=LOW + 3)[1 : LOW + 2].astype(np.int64)


def _count_words(parts: int):
    """Number and corpus count of each word a block sent, and what the partition adds to the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in grouped(batches, "part"):
            blocks = [(r[2], *unpack(r[3])) for r in found]
            _, at = np.unique(np.concatenate([b[1] for b in blocks]), return_inverse=True)
            c = np.bincount(at, np.concatenate([b[2] for b in blocks])).astype(np.int64)
            rank = np.empty(len(c), np.int64)
            rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
            number = rank * parts + part
            yield rows([(STATS, part, -1, pack(np.array([c.sum(), (c > 0).sum()], np.int64), counts_of_counts(c)))])
            done = 0
            for block, digests, _ in blocks:
                own = at[done : done + len(digests)]
                done += len(digests)
                yield rows([(COUNTS, part, block, pack(number[own], c[own]))])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """d(r) for r = 0 .. LOW from the number of n-grams seen r = 1 .. LOW + 1 times.

    Good-Turing with the largest k up to LOW for which all discounts lie
    between 0 and 1; without one, (r - D) / r with D = n1 / (n1 + 2 n2), or a
    half where that isn't between 0 and 1.
    """
    n = n.astype(float)
    for k in range(LOW, 0, -1):
        if (n[: k + 1] > 0).all():
            r = np.arange(1, k + 1)
            cut = (k + 1) * n[k] / n[0]
            if cut < 1:
                d = ((r + 1) * n[1 : k + 1] / (r * n[:k]) - cut) / (1 - cut)
                if ((d > 0) & (d < 1)).all():
                    return np.concatenate([[1.0], d, np.ones(LOW - k)])
    share = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    r = np.arange(1, LOW + 1)
    return np.concatenate([[1.0], (r - share) / r])


class Unigrams:
    """P(w) from a word's count. Its size doesn't depend on the corpus."""

    def __init__(self, total: int, distinct: int, n: np.ndarray):
        self.total, self.distinct, self.n = total, distinct, n
        self.d = discounts(n)
        r = np.arange(1, LOW + 1)
        freed = float(((1 - self.d[1:]) * r * n[:LOW]).sum())
        self.plain = total == 0 or freed <= 0  # nothing is left for unknown words: one is added to every count then
        self.unknown = 1.0 / (total + distinct + 1) if self.plain else freed / total

    def p(self, c: np.ndarray) -> np.ndarray:
        if self.plain:
            return (c + 1) / (self.total + self.distinct + 1)
        return np.where(c > 0, self.d[np.where(c <= LOW, c, 0)] * c / max(self.total, 1), self.unknown)


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row of the columns (numbers from 0) first stands, in their order, and which one each row is. Exact for numbers of any size."""
    sizes = [int(c.max(initial=0)) + 1 for c in columns]
    if math.prod(sizes) < 1 << 63:
        key = columns[0].astype(np.int64)
        for c, size in zip(columns[1:], sizes[1:], strict=True):
            key = key * size + c
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        return first, which
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class Level:
    """A block's distinct n-grams of one order, as it sends them: by partition, context and word.

    context and w of each n-gram; words of each context; train: the block's own
    count; suffix: the n-gram of the order below, with the corpus's count
    lower; total of each context; split: contexts that lie in several
    partitions; token: the n-gram of each token.
    """

    def __init__(self, block: Block, words: list[np.ndarray], below_token: np.ndarray, below: np.ndarray, total: np.ndarray, parts: int, all_: int, spread: float):
        first, ctx = distinct(*words)
        at, self.token = distinct(ctx, block.w)
        self.context, self.w, self.suffix = ctx[at], block.w[at], below_token[at]
        self.words, self.total = [w[first] for w in words], total[first]
        self.train = np.bincount(self.token[block.train], minlength=len(at)).astype(np.int32)
        self.lower = below[self.suffix]
        ways = 1 + (self.total * parts // max(1, spread * all_)).astype(np.int64)
        self.split = ways > 1
        home = np.zeros(len(first), np.uint64)
        for w in self.words:
            home = mixed(home ^ mixed(block.number[w].astype(np.uint64)))
        lot = mixed(block.number[self.w].astype(np.uint64)) % ways[self.context].astype(np.uint64)
        self.to = ((home[self.context] + lot * np.uint64(max(1, parts // 7) | 1)) % np.uint64(parts)).astype(np.uint32)
        self.order = np.argsort(self.to, kind="stable")

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(partition, its n-grams, where a new context begins in them)."""
        for part, at in _runs(self.to[self.order]):
            own = self.order[at]
            c = self.context[own]
            yield part, own, np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])


class Block:
    """A block's documents, by corpus-wide word numbers, and its levels up to an order; `found` has the counts of all but the last of them."""

    def __init__(self, found: list[tuple], parts: int, total: int, spread: float, order: int):
        docs = next(r for r in found if r[0] == DOCS)
        self.ids, self.known, self.held, self.lens, flat, part, end = unpack(docs[3])
        by_part = np.argsort(part, kind="stable")
        got = [unpack(r[3]) for r in sorted((r for r in found if r[0] == COUNTS), key=lambda r: r[1])]
        number, c = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        number[by_part], c[by_part] = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        by_number = np.argsort(number, kind="stable")
        place = np.empty(len(part), np.int64)
        place[by_number] = np.arange(len(part))
        self.number, self.c = number[by_number], c[by_number]
        self.w, self.end = place[flat], int(place[end[0]])
        self.train = np.repeat(self.held == 0, self.lens)
        in_text = np.arange(len(self.w)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        counts = {(r[0], r[1]): r[3] for r in found if r[0] >= FOUND}
        self.levels: list[Level] = []
        self.counts: list[np.ndarray] = []  # the corpus's, of each level but the last
        self.sums: list[tuple[np.ndarray, np.ndarray]] = []  # low and weight of each context, of each level but the last
        token, below = self.w, self.c
        for k in range(1, order):
            words = [np.where(in_text >= j, np.concatenate([np.full(j, self.end), self.w[:-j]]), self.end) for j in range(k, 0, -1)]
            context_total = np.where(in_text > 0, np.concatenate([[0], below[token][:-1]]), self.c[self.end])
            level = Level(self, words, token, below, context_total, parts, total, spread)
            self.levels.append(level)
            if (FOUND + k - 1, level.to[level.order[0]]) not in counts:
                break
            count, low, weight = np.empty(len(level.w), np.int64), np.zeros((len(level.total), LOW)), np.zeros(len(level.total))
            for p, own, start in level.runs():
                mine, *rest = unpack(counts[FOUND + k - 1, p])
                count[own] = mine
                low[level.context[own[start]]], weight[level.context[own[start]]] = np.stack(rest[:LOW], axis=1), rest[LOW]
            self.counts.append(count)
            self.sums.append((low, weight))
            token, below = level.token, count

    def context_number(self, level: Level, context: int) -> tuple[int, ...]:
        return tuple(int(self.number[w[context]]) for w in level.words)


def _send_grams(parts: int, total: int, spread: float, order: int):
    """For each partition, its contexts and their words with the block's training counts, sorted by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, found in grouped(batches, "block"):
            b = Block(found, parts, total, spread, order)
            v = b.levels[order - 2]
            for part, own, start in v.runs():
                w = b.number[v.w[own]]
                step = np.diff(w, prepend=0)
                step[start] = w[start]  # words of a context by their differences
                contexts = v.context[own[start]]
                names = [np.diff(b.number[x[contexts]], prepend=0) for x in v.words]
                yield rows([(GRAMS, part, number, pack(*names, np.diff(start, append=len(own)).astype(np.int32), v.split[contexts].astype(np.uint8), step, v.train[own], v.lower[own]))])

    return run


def _count_grams(weigh, order: int):
    """The corpus's count of each n-gram sent; of each context, how many words it has of each low count, and their suffixes' weight together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in grouped(batches, "part"):
            names, sizes, splits, ws, trains, lowers = [], [], [], [], [], []
            for r in found:
                *own, size, split, step, train, lower = unpack(r[3])
                run_sum, ends = np.cumsum(step), np.cumsum(size)
                base = np.concatenate([[0], run_sum[ends[:-1] - 1]])
                names.append([np.cumsum(x) for x in own])
                ws.append(run_sum - np.repeat(base, size))
                for to, x in ((sizes, size), (splits, split), (trains, train), (lowers, lower)):
                    to.append(x)
            words = [np.concatenate(x) for x in zip(*names, strict=True)]
            first, sent = distinct(*words)  # of contexts, each block's own
            at, gram = distinct(np.repeat(sent, np.concatenate(sizes)), np.concatenate(ws))
            context = np.repeat(sent, np.concatenate(sizes))[at]
            count = np.bincount(gram, np.concatenate(trains)).astype(np.int64)
            lower, seen = np.concatenate(lowers)[at], count > 0
            low = np.stack([np.bincount(context[count == k], minlength=len(first)) for k in range(1, LOW + 1)]).astype(np.int32)
            weight = np.bincount(context[seen], weigh(lower[seen]), len(first))
            yield rows([(STATS, part, -1, pack(counts_of_counts(count)))])
            hot = np.unique(sent[np.concatenate(splits) > 0])
            if len(hot):
                yield rows([(HOT, part, -1, pack(*[x[first[hot]] for x in words], *low[:, hot], weight[hot]))])
            done, upto = 0, 0
            for row, size in zip(found, sizes, strict=True):
                own, n = sent[done : done + len(size)], int(size.sum())
                yield rows([(FOUND + order - 2, part, row[2], pack(count[gram[upto : upto + n]].astype(np.int32), *low[:, own], weight[own]))])
                done, upto = done + len(size), upto + n

    return run


Hot = dict[tuple[int, ...], tuple[np.ndarray, float]]


def probabilities(b: Block, unigrams: Unigrams, d: list[np.ndarray], hot: list[Hot]) -> np.ndarray:
    """P of each token: order by order, the discounted share where the n-gram was seen, else the weight of its context times P of the suffix."""
    p, total_below, total = unigrams.p(b.c), None, None
    for k, level in enumerate(b.levels):
        count, (low, weight) = b.counts[k], b.sums[k]
        if hot[k]:
            for i in np.flatnonzero(level.split).tolist():
                low[i], weight[i] = hot[k][b.context_number(level, i)]
        freed = (low * np.arange(1, LOW + 1) * (1 - d[k][1:])).sum(axis=1)
        bare = freed <= 0  # all its words are frequent: its total gains one for the others
        total = np.where(bare, level.total + 1, level.total).astype(float)
        if k:  # the weights are discounted counts, whose total is that of the shorter context
            weight = weight / np.maximum(_of_contexts(level, total_below[b.levels[k - 1].context[level.suffix]]), 1)
        left = np.where(bare, 1.0, freed) / np.maximum(total, 1)
        alpha = np.where(level.total > 0, left / np.maximum(1 - weight, 1e-300), 1.0)
        p = np.where(count > 0, d[k][np.where(count <= LOW, count, 0)] * count / np.maximum(total[level.context], 1), alpha[level.context] * p[level.suffix if k else level.w])
        total_below = total
    return p[b.levels[-1].token] if b.levels else p[b.w]


def _of_contexts(level: Level, of_gram: np.ndarray) -> np.ndarray:
    """What all n-grams of a context have in common, for each context."""
    out = np.zeros(len(level.total))
    out[level.context] = of_gram
    return out


OUT_DDL = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(parts: int, unigrams: Unigrams, d: list[np.ndarray], hot: list[Hot], spread: float, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in grouped(batches, "block"):
            b = Block(found, parts, unigrams.total, spread, order)
            starts = np.cumsum(b.lens) - b.lens
            c = b.c[b.w]
            base = np.add.reduceat(np.log10((c + 1) / (unigrams.total + unigrams.distinct + 1)), starts)
            score = np.add.reduceat(np.log10(probabilities(b, unigrams, d, hot)), starts)
            known = np.add.reduceat((c > 0).astype(np.int64), starts)
            ids = pa.array(b.ids, pa.int64(), mask=b.known == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(b.held > 0), pa.array(b.lens.astype(np.int64)), pa.array(known), pa.array(np.full(len(known), unigrams.total, np.int64)), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: list[np.ndarray] | None = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            own = unpack(x)
            total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pack(*total)], pa.binary())], names=["data"])


def _totals(df: DataFrame) -> list[np.ndarray]:
    """Sums of the STATS rows' arrays: a few numbers from each task that reads the table."""
    got = [unpack(r["data"]) for r in df.where(F.col("kind") == STATS).select("data").mapInArrow(_sum, "data binary").collect()]
    return [np.sum(x, axis=0) for x in zip(*got, strict=True)]


class Discounted:
    """d(c) c of n-grams that were seen."""

    def __init__(self, d: np.ndarray):
        self.d = d

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return self.d[np.where(c <= LOW, c, 0)] * c


def _hot(found: DataFrame, words: int) -> Hot:
    """Sums of split contexts, by their words' numbers: a row a partition, with no more contexts in all than partitions, twice."""
    out: Hot = {}
    for r in found.where(F.col("kind") == HOT).select("data").collect():
        arrays = unpack(r["data"])
        low, weight = np.stack(arrays[words:-1], axis=1), arrays[-1]
        for i, name in enumerate(zip(*(x.tolist() for x in arrays[:words]), strict=True)):
            was = out.get(name, (np.zeros(LOW), 0.0))
            out[name] = was[0] + low[i], was[1] + float(weight[i])
    return out


def katz_scores(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, spread: float = SPREAD) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every row's whole text.

    The model learns from the rows where `held_out` isn't true. Words are runs
    of anything but [\\x20\\x09-\\x0D], A-Z in lower case; a text is its words
    and one end, so null and empty texts have one token. score is the model's
    log10 probability of the text, base_score that of add-one unigrams. `order`
    is the longest n-gram's number of words, 1 or more.
    Repeated rows count each and get equal scores; an empty table gives an
    empty one; with no training row every token is unknown, of probability 1.
    """
    spark = df.sparkSession
    docs = df.select(column(df, id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), column(df, text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions_for(spark)
    parts = max(n, -(-size // PART))
    sent = written(docs.mapInArrow(_blocks(parts), ROWS_DDL), "words")
    blocks, words = sent.where(F.col("kind") == DOCS), sent.where(F.col("kind") == WORDS)
    by_part = lambda x: x.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part")
    by_block = lambda x: x.repartition(n, "block").sortWithinPartitions("block")
    counts = written(by_part(words).mapInArrow(_count_words(parts), ROWS_DDL), "counts")
    total, n_words = _totals(counts) or [np.zeros(2, np.int64), np.zeros(LOW + 1, np.int64)]
    unigrams = Unigrams(int(total[0]), int(total[1]), n_words)
    known = blocks.union(counts.where(F.col("kind") == COUNTS))
    d, hot, tables = [], [], []
    for k in range(2, order + 1):
        weigh = unigrams.p if k == 2 else Discounted(d[-1])
        grams = by_block(known).mapInArrow(_send_grams(parts, unigrams.total, spread, k), ROWS_DDL)
        found = written(by_part(grams).mapInArrow(_count_grams(weigh, k), ROWS_DDL), "grams")
        tables.append(found)
        d.append(discounts((_totals(found) or [np.zeros(LOW + 1, np.int64)])[0]))
        hot.append(_hot(found, k - 1))
        known = known.union(found.where(F.col("kind") >= FOUND))
    scored = by_block(known).mapInArrow(_score(parts, unigrams, d, hot, spread, order), OUT_DDL)
    scores = written(scored, "scores")
    delete_written(sent, counts, *tables)
    return scores.withColumnRenamed("id", id_col)


__all__ = ["Unigrams", "discounts", "katz_scores"]
