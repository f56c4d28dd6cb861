"""Array kernels behind the Arrow operators: a batch of reads is a matrix of bytes, a row for each read.

Every kernel works on all reads of a batch at once, position by position, so
Python's cost is per batch and not per read. Trims are ranges of columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FULL = 1 << 30  # a minimum overlap that no pattern reaches: the match must lie inside the window
FAR = np.iinfo(np.int32).max  # no match; more edits than a read has bases
ANY = 1  # a byte that every base matches
N = ord("N")
ERROR = 10.0 ** (-np.arange(256) / 10)  # of a Phred score


def to_matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Left-aligned bytes (0 behind the end) and lengths; a null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    bounds = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    lens = np.diff(bounds).astype(np.int64)
    mat = np.zeros((len(lens), int(lens.max(initial=0))), np.uint8)
    if bounds[-1] > bounds[0]:
        mat[np.arange(mat.shape[1]) < lens[:, None]] = np.frombuffer(col.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return mat, lens


def to_strings(mat: np.ndarray, lens: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    data = mat[np.arange(mat.shape[1]) < lens[:, None]].tobytes() if mat.size else b""
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data))


def cut(mat: np.ndarray, lens: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns start .. end of each row, left-aligned."""
    start, end = np.minimum(start, lens), np.minimum(end, lens)
    size = np.maximum(end - start, 0)
    width = int(size.max(initial=0))
    at = np.arange(width)
    got = np.take_along_axis(mat, np.minimum(start[:, None] + at, max(mat.shape[1] - 1, 0)), axis=1) if mat.shape[1] else np.zeros((len(lens), width), np.uint8)
    return np.where(at < size[:, None], got, 0).astype(np.uint8), size


def upper(mat: np.ndarray) -> np.ndarray:
    return np.where((mat >= 97) & (mat <= 122), mat - 32, mat).astype(np.uint8)


def reversed_rows(mat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    at = lens[:, None] - 1 - np.arange(mat.shape[1])
    return np.where(at >= 0, np.take_along_axis(mat, np.maximum(at, 0), axis=1), 0).astype(np.uint8) if mat.shape[1] else mat


COMPLEMENT = np.arange(256, dtype=np.uint8)
COMPLEMENT[list(b"ACGTNacgtn")] = list(b"TGCANtgcan")


@dataclass(frozen=True)
class Budget:
    """Edits that a match may have: a number, or a share of its length."""

    edits: int = 1
    share: float | None = None

    @classmethod
    def of(cls, x: float) -> Budget:
        """A number below 1 is a share, except 0."""
        return cls(0, float(x)) if 0 < x < 1 else cls(int(x))

    def allowed(self, length: np.ndarray) -> np.ndarray:
        return length * self.share if self.share is not None else np.full(length.shape, self.edits)

    def slack(self, length: int) -> int:
        return int(self.share * length) if self.share is not None else self.edits


@dataclass(frozen=True)
class Search:
    """How a pattern is looked for. prior: match by posterior probability instead of edits."""

    budget: Budget = Budget()
    indels: bool = False
    overlap: int = FULL
    wildcard: bool = False
    prior: float | None = None

    def slack(self, length: int) -> int:
        return self.budget.slack(length) if self.indels and self.prior is None else 0


def equal(x: np.ndarray, y: int, wildcard: bool) -> np.ndarray:
    if y == N and wildcard:
        return (x == ANY) | np.isin(x, list(b"ATCGN"))
    same = (x == y) | (x == ANY)
    return same | (x == N) if wildcard else same


def edits_at_ends(text: np.ndarray, lens: np.ndarray, pattern: bytes, how: Search, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edits of the best alignment of the pattern that ends at each column, FAR where none is allowed; and nominal lengths of the columns.

    The pattern may hang over the left edge by all but `overlap` of its bases,
    which match whatever they like. `first` is the column's place in the whole
    read, from which the nominal length min(place + 1, pattern) counts; with
    first > 0 the overlap must be FULL.
    """
    n, width = text.shape
    m = len(pattern)
    hang = m - min(how.overlap, m)
    length = np.minimum(np.arange(width) + first + 1, m)
    if not width:
        return np.empty((n, 0), np.int32), length
    padded = np.concatenate([np.full((n, hang), ANY, np.uint8), text], axis=1)
    if how.indels:
        col = [np.full(n, j, np.int32) for j in range(m + 1)]
        found = np.empty((n, width), np.int32)
        miss = {y: (~equal(padded, y, how.wildcard)).astype(np.int32) for y in set(pattern)}
        for i in range(hang + width):
            diagonal = col[0]
            for j in range(1, m + 1):
                best = np.minimum(np.minimum(col[j], col[j - 1]) + 1, diagonal + miss[pattern[j - 1]][:, i])
                diagonal, col[j] = col[j], best
            if i >= hang:
                found[:, i - hang] = col[m]
    else:
        reach = hang + width - m + 1
        found = np.full((n, width), FAR, np.int32)
        if reach > 0:
            total = np.zeros((n, reach), np.int32)
            for k, y in enumerate(pattern):
                total += ~equal(padded[:, k : k + reach], y, how.wildcard)
            found[:, width - reach :] = total
    ok = (np.arange(width) < lens[:, None]) & (length >= min(how.overlap, m)) & (found <= how.budget.allowed(length))
    return np.where(ok, found, FAR), length


def best_posterior(text: np.ndarray, qual: np.ndarray, lens: np.ndarray, pattern: bytes, how: Search, from_col: np.ndarray | int = 0) -> np.ndarray:
    """The end with the greatest posterior probability of a match over a random one, the first of equals; -1 if none is likelier.

    Overlaps start at the read's first column, wherever the ends may start.
    """
    n, width = text.shape
    m, best, end = len(pattern), np.zeros(n), np.full(n, -1)
    err = ERROR[np.maximum(qual.astype(np.int64) - 33, 0)]
    for i in range(width):
        match, chance, log_match, log_chance = np.ones(n), np.ones(n), np.zeros(n), np.zeros(n)
        for j in range(max(i - m + 1, 0), i + 1):
            x, y, e = text[:, j], pattern[m - 1 - (i - j)], err[:, j]
            same = x == y
            a, b = np.where(same, 1 - e, e), np.where(same, 0.25, 0.75)
            if how.wildcard:
                skip = (x == N) | (y == N)
                a, b = np.where(skip, 1.0, a), np.where(skip, 1.0, b)
            match, chance = match * a, chance * b
            with np.errstate(divide="ignore"):
                log_match, log_chance = log_match + np.log(a), log_chance + np.log(b)
        p = posterior(match, chance, log_match, log_chance, how.prior)
        ok = (i < lens) & (i >= from_col + max(min(how.overlap, m) - 1, 0)) & (p > 0.5) & (p > best)
        best, end = np.where(ok, p, best), np.where(ok, i, end)
    return end


def posterior(match: np.ndarray, chance: np.ndarray, log_match: np.ndarray, log_chance: np.ndarray, prior: float) -> np.ndarray:
    """P(match | bases); by logarithms where the products underflow."""
    a, b = match * prior, chance * (1 - prior)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        by_log = 1 / (1 + np.exp(np.clip(log_chance - log_match, -700, 700)) * (1 - prior) / max(prior, 1e-300))
        return np.where(a + b > 0, a / np.where(a + b > 0, a + b, 1), np.where(np.isfinite(log_match), by_log, 0.0))


def longest(edits: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, edits, length) of the longest match, of fewest edits, at the smallest end; end -1 if there is none."""
    n, width = edits.shape
    if not width:
        return np.full(n, -1), np.full(n, FAR), np.zeros(n, np.int64)
    size = np.where(edits < FAR, length[None, :], -1)
    most = size.max(axis=1)
    end = np.where(size == most[:, None], edits, FAR).argmin(axis=1)
    none = most < 0
    return np.where(none, -1, end), np.where(none, FAR, edits[np.arange(n), end]), np.where(none, 0, length[end])


def fewest(edits: np.ndarray, last: bool) -> np.ndarray:
    """The last or first end with the fewest edits; -1 if there is none."""
    n, width = edits.shape
    if not width:
        return np.full(n, -1)
    end = width - 1 - edits[:, ::-1].argmin(axis=1) if last else edits.argmin(axis=1)
    return np.where(edits[np.arange(n), end] < FAR, end, -1)


def score_means(qual: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Mean score of each read, NaN of an empty one."""
    inside = np.arange(qual.shape[1]) < lens[:, None]
    total = np.where(inside, qual.astype(np.int64) - 33, 0).sum(axis=1)
    return np.where(lens > 0, total / np.maximum(lens, 1), np.nan)


def error_sums(qual: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Expected wrong bases of each read."""
    inside = np.arange(qual.shape[1]) < lens[:, None]
    return np.where(inside, ERROR[np.maximum(qual.astype(np.int64) - 33, 0)], 0.0).sum(axis=1)


def n_trim(mat: np.ndarray, lens: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Range left by trimming Ns from both ends.

    From the first base that isn't N, of all prefixes with a share of Ns (the
    leading run counts in the denominator alone) of `share` or more, the one
    with the greatest share, the longest of equals, is cut off; without one,
    the leading Ns are. Then the same from the other end, where a cut of
    everything is none.
    """
    n, width = mat.shape
    if share > 1 or not width:
        return np.zeros(n, np.int64), lens.copy()
    at = np.arange(width)

    def one(is_n: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = at < size[:, None]
        base = ~is_n & inside
        first = np.where(base.any(axis=1), base.argmax(axis=1), size)
        part = (np.cumsum(is_n & inside, axis=1) - first[:, None]) / (at + 1.0)
        part = np.where(inside & (at >= first[:, None]) & (part >= share), part, -1)
        last = width - 1 - part[:, ::-1].argmax(axis=1)
        return first, np.where(part[np.arange(n), last] >= 0, last + 1, first)

    is_n = upper(mat) == N
    first, start = one(is_n, lens)
    none = first >= lens
    start = np.where(none, lens, start)
    size = lens - start
    rest, _ = cut(np.where(is_n, N, ANY).astype(np.uint8), lens, start, lens)
    width, at = rest.shape[1], np.arange(rest.shape[1])
    if not width:
        return start, start.copy()
    back = reversed_rows(rest, size) == N
    some = ((~back) & (at < size[:, None])).any(axis=1)
    _, gone = one(back, size)
    gone = np.where(gone >= size, 0, gone)
    return np.where(none, 0, start), np.where(none, 0, np.where(some, lens - gone, lens))


def quality_trim(mat: np.ndarray, qual: np.ndarray, lens: np.ndarray, least: int, left: bool, window: int | None, running: bool) -> tuple[np.ndarray, np.ndarray]:
    """Range left by trimming one end up to the first base that passes; none passes: nothing is left; least 0: nothing is cut.

    running: the sum of (score - least) over the last `window` bases is 0 or
    more. Otherwise: the mean score of the bases within `window` whose score
    isn't above the base's own is `least` or more. window None: no limit.
    """
    n, width = mat.shape
    if least == 0 or not width:
        return np.zeros(n, np.int64), lens.copy()
    q = np.zeros((n, width), np.int64)
    k = min(width, qual.shape[1])
    q[:, :k] = qual[:, :k].astype(np.int64) - 33
    at = np.arange(width)
    inside = at < lens[:, None]
    if running:
        over = np.where(inside, q - least, 0)
        if not left:
            over = over[:, ::-1]
        total = np.cumsum(over, axis=1)
        if window is not None and window < width:
            total[:, window:] -= total[:, :-window].copy()
        if not left:
            total = total[:, ::-1]
        ok = inside & (total >= 0)
    else:
        reach = width if window is None else min(window, width)
        total, count = np.zeros((n, width)), np.zeros((n, width))
        for d in range(-reach, reach + 1):
            a, b = max(0, -d), min(width, width - d)
            if a < b:
                there = q[:, a + d : b + d]
                use = inside[:, a + d : b + d] & (there <= q[:, a:b])
                total[:, a:b] += np.where(use, there, 0)
                count[:, a:b] += use
        ok = inside & (total / np.maximum(count, 1) >= least)
    some = ok.any(axis=1)
    if left:
        return np.where(some, ok.argmax(axis=1), 0), np.where(some, lens, 0)
    return np.zeros(n, np.int64), np.where(some, width - ok[:, ::-1].argmax(axis=1), 0)


@dataclass(frozen=True)
class Adapter:
    """A sequence at the 5' end (start) or the 3' end; anchored: right at the end."""

    seq: str
    start: bool = False
    anchored: bool = False

    def __post_init__(self) -> None:
        if not self.seq:
            raise ValueError("an adapter can't be empty")

    @classmethod
    def five(cls, text: str) -> Adapter:
        return cls(text[1:], True, True) if text.startswith("^") else cls(text, True)

    @classmethod
    def three(cls, text: str) -> Adapter:
        return cls(text[:-1], False, True) if text.endswith("$") else cls(text)


def adapter_range(mat: np.ndarray, qual: np.ndarray, lens: np.ndarray, adapters: list[Adapter], how: Search, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Range left by cutting the best adapter: the longest match, of fewest edits, of the first adapter in the list."""
    n = len(lens)
    best_length, best_edits = np.zeros(n, np.int64), np.full(n, FAR)
    start, end = np.zeros(n, np.int64), lens.copy()
    text = upper(mat)
    back, back_q = (reversed_rows(text, lens), reversed_rows(qual, lens)) if any(not a.start for a in adapters) else (text, qual)
    for a in adapters:
        seq = a.seq.upper().encode()
        t, q, pattern = (text, qual, seq) if a.start else (back, back_q, seq[::-1])
        size = np.minimum((0 if a.anchored else offset) + len(seq) + how.slack(len(seq)), lens)
        t = t[:, : int(size.max(initial=0))]
        own = Search(how.budget, how.indels, FULL if a.anchored else how.overlap, how.wildcard, how.prior)
        if how.prior is not None:
            at = best_posterior(t, q[:, : t.shape[1]], size, pattern, own)
            edits, length = np.where(at >= 0, 0, FAR), np.minimum(at + 1, len(seq))
        else:
            found, lengths = edits_at_ends(t, size, pattern, own)
            if a.anchored:
                at = fewest(found, last=True)
                edits = np.where(at >= 0, found[np.arange(n), at] if found.shape[1] else FAR, FAR)
                length = np.where(at >= 0, lengths[at] if found.shape[1] else 0, 0)
            else:
                at, edits, length = longest(found, lengths)
        better = (at >= 0) & ((length > best_length) | (length == best_length) & (edits < best_edits))
        best_length, best_edits = np.where(better, length, best_length), np.where(better, edits, best_edits)
        start = np.where(better, at + 1 if a.start else 0, start)
        end = np.where(better, lens if a.start else lens - 1 - at, end)
    return start, end


def quality_byte(error: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.floor(-10 * np.log10(np.maximum(error, 1e-300)) + 0.5)
    return np.clip(score + 33, 33, 126).astype(np.uint8)


def consensus_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quality bytes of a pair of scores 0 .. 93, for equal and for different bases."""
    e1, e2 = ERROR[:94, None], ERROR[None, :94]
    with np.errstate(divide="ignore", invalid="ignore"):
        same = (e1 * e2 / 3) / (1 - e1 - e2 + 4 * e1 * e2 / 3)
        low, high = np.minimum(e1, e2), np.maximum(e1, e2)
        other = low * (1 - high / 3) / (low + high - 4 * low * high / 3)
    return quality_byte(np.nan_to_num(same, nan=1.0)), quality_byte(np.nan_to_num(other, nan=1.0))


SAME, OTHER = consensus_tables()


def merge_start(up1: np.ndarray, n1: np.ndarray, q1: np.ndarray, up2: np.ndarray, n2: np.ndarray, q2: np.ndarray, how: Search) -> np.ndarray:
    """Where the turned reverse read begins in the forward read; -1 if they don't overlap well (which -1 itself also means)."""
    n, w2 = up2.shape
    w1 = up1.shape[1]
    right = np.take_along_axis(up1, np.maximum(np.arange(w1) - (w1 - n1)[:, None], 0), axis=1) if w1 else up1  # right-aligned
    usable = np.arange(w1) >= (w1 - n1)[:, None]
    right_q = np.take_along_axis(q1, np.clip(np.arange(w1) - (w1 - n1)[:, None], 0, max(q1.shape[1] - 1, 0)), axis=1) if w1 and q1.shape[1] else np.full((n, w1), 33, np.uint8)
    start, best_length, best_edits, best = np.full(n, -1), np.zeros(n, np.int64), np.full(n, FAR), np.zeros(n)
    for e in range(w2):
        k = min(e + 1, w1)
        a, b, use = right[:, w1 - k :], up2[:, e + 1 - k : e + 1], usable[:, w1 - k :]
        length = np.minimum(e + 1, n1)
        inside = (e < n2) & (length >= np.minimum(how.overlap, n1))
        same = a == b
        if how.wildcard:
            blank = (a == N) | (b == N)
        if how.prior is None:
            differ = ((~(same | blank) if how.wildcard else ~same) & use).sum(axis=1)
            ok = inside & (length > 0) & (differ <= how.budget.allowed(length))
            better = ok & ((length > best_length) | (length == best_length) & (differ < best_edits))
            best_length, best_edits = np.where(better, length, best_length), np.where(better, differ, best_edits)
        else:
            ea, eb = (ERROR[np.maximum(x.astype(np.int64) - 33, 0)] for x in (right_q[:, w1 - k :], q2[:, e + 1 - k : e + 1]))
            both = (1 - ea) * (1 - eb)
            skip = ~use | blank if how.wildcard else ~use
            m, c = np.where(skip, 1.0, np.where(same, both, 1 - both)), np.where(skip, 1.0, np.where(same, 0.25, 0.75))
            with np.errstate(divide="ignore"):
                p = posterior(m.prod(axis=1), c.prod(axis=1), np.log(m).sum(axis=1), np.log(c).sum(axis=1), how.prior)
            better = inside & (p > 0.5) & (p > best)
            best = np.where(better, p, best)
        start = np.where(better, n1 - 1 - e, start)
    return start


def merge_pairs(s1: np.ndarray, q1: np.ndarray, n1: np.ndarray, s2: np.ndarray, q2: np.ndarray, n2: np.ndarray, how: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bases, qualities, length, start) of the merged read; start -1: the two stand one after the other.

    The reverse read is turned (reverse complement). Where both have a base,
    equal ones keep the forward's and gain quality; of different ones the less
    likely error wins, the reverse's among equals. A start below -1 drops what
    the reverse read has before the forward read.
    """
    q1, q2 = (np.pad(q, ((0, 0), (0, max(0, s.shape[1] - q.shape[1]))), constant_values=33)[:, : s.shape[1]] for q, s in ((q1, s1), (q2, s2)))
    t2, tq = reversed_rows(COMPLEMENT[s2], n2), reversed_rows(q2, n2)
    up1, up2 = upper(s1), upper(t2)
    start = merge_start(up1, n1, q1, up2, n2, tq, how)
    at_end = start == -1
    shift = np.where(at_end, n1, start)
    total = np.where(at_end, n1 + n2, np.maximum(n1, start + n2))
    width = int(total.max(initial=0))
    at = np.arange(width)[None, :]
    take = lambda x, i: np.take_along_axis(x, np.clip(i, 0, max(x.shape[1] - 1, 0)), axis=1) if x.shape[1] else np.zeros((len(n1), width), np.uint8)
    j = at - shift[:, None]
    in1, in2 = at < n1[:, None], (j >= 0) & (j < n2[:, None])
    a, b, qa, qb = take(s1, at + 0 * j), take(t2, j), take(q1, at + 0 * j), take(tq, j)
    ua, ub = upper(a), upper(b)
    same = ua == ub
    if how.wildcard:
        same |= (ua == N) | (ub == N)
    pa_, pb = np.clip(qa.astype(np.int64) - 33, 0, 93), np.clip(qb.astype(np.int64) - 33, 0, 93)
    both = in1 & in2
    base = np.where(both, np.where(same | (pa_ > pb), a, b), np.where(in1, a, b))
    qual = np.where(both, np.where(same, SAME[pa_, pb], OTHER[pa_, pb]), np.where(in1, qa, qb))
    inside = at < total[:, None]
    return np.where(inside, base, 0).astype(np.uint8), np.where(inside, qual, 0).astype(np.uint8), total, start
