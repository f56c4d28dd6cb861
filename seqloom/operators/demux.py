"""Demultiplexing: each read's sample by its barcode and the enzyme remnant behind it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .arrow import add_columns

MATCHED = [("sample", T.StringType()), ("sample_idx", T.IntegerType()), ("barcode_end", T.IntegerType()), ("enzyme_end", T.IntegerType()), ("r_barcode_end", T.IntegerType()), ("r_enzyme_end", T.IntegerType()), ("edits", T.IntegerType())]


@dataclass(frozen=True)
class Sample:
    """A row of the sample sheet; without a reverse barcode it is the complement of the forward one."""

    name: str
    barcode: str
    enzymes: tuple[str, ...] = ("",)
    r_enzymes: tuple[str, ...] | None = None
    r_barcode: str | None = None

    def reverse(self) -> tuple[str, tuple[str, ...]]:
        turned = self.barcode.translate(str.maketrans("ACGTN", "TGCAN"))
        return self.r_barcode or turned, self.enzymes if self.r_enzymes is None else self.r_enzymes


@dataclass(frozen=True)
class Demux:
    """samples, and how they are looked for. offset: bases that may stand before a barcode or an enzyme remnant."""

    samples: tuple[Sample, ...] = ()
    how: K.Search = field(default_factory=K.Search)
    offset: int = 0
    check_reverse: bool = False
    single_only: bool = False
    index_offset: int = 0  # of the reverse barcode in the reverse index read

    def __post_init__(self) -> None:
        barcodes = [s.barcode for s in self.samples]
        if len(set(barcodes)) < len(barcodes):
            raise ValueError("barcodes of the sample sheet must differ")


def _window(text: np.ndarray, qual: np.ndarray, lens: np.ndarray, start: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return text[:, start : start + size], qual[:, start : start + size], np.clip(lens - start, 0, size)


def _enzyme_end(text: np.ndarray, qual: np.ndarray, lens: np.ndarray, start: int, enzymes: tuple[str, ...], d: Demux) -> np.ndarray:
    """Behind the first enzyme remnant that is found from column `start` on, at its smallest end of fewest edits; -1 if none is."""
    out = np.full(len(lens), -1)
    for z in enzymes:
        if not z:
            found = np.full(len(lens), start)
        else:
            seq = z.upper().encode()
            size = d.offset + len(seq) + d.how.slack(len(seq))
            if d.how.prior is not None:
                stop = np.minimum(lens, start + size)
                end = K.best_posterior(text[:, : start + size], qual[:, : start + size], stop, seq, d.how, start)
                found = np.where(end >= 0, end + 1, -1)
            else:
                t, _, n = _window(text, qual, lens, start, size)
                edits, _ = K.edits_at_ends(t, n, seq, K.Search(d.how.budget, d.how.indels, K.FULL, d.how.wildcard), start)
                end = K.fewest(edits, last=False)
                found = np.where(end >= 0, start + end + 1, -1)
        out = np.where(out < 0, found, out)
    return out


def _best(text: np.ndarray, qual: np.ndarray, lens: np.ndarray, barcode: str, enzymes: tuple[str, ...], d: Demux) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(barcode end, enzyme end, edits, length) of the barcode with the fewest edits, then the longest, that a remnant follows; ends are -1 without one."""
    n, seq = len(lens), barcode.upper().encode()
    size = d.offset + len(seq) + d.how.slack(len(seq))
    t, q, stop = _window(text, qual, lens, 0, size)
    if d.how.prior is not None:
        end = K.best_posterior(t, q, stop, seq, d.how)
        edits = np.where(np.arange(t.shape[1]) == end[:, None], 0, K.FAR)
        lengths = np.minimum(np.arange(t.shape[1]) + 1, len(seq))
    else:
        edits, lengths = K.edits_at_ends(t, stop, seq, d.how)
    at, tail = np.full(n, -1), np.full(n, -1)
    fewest, longest = np.full(n, K.FAR), np.zeros(n, np.int64)
    for j in range(edits.shape[1]):
        hit = edits[:, j] < K.FAR
        if not hit.any():
            continue
        behind = _enzyme_end(text, qual, lens, j + 1, enzymes, d)
        better = hit & (behind >= 0) & ((edits[:, j] < fewest) | (edits[:, j] == fewest) & (lengths[j] > longest))
        at, tail = np.where(better, j + 1, at), np.where(better, behind, tail)
        fewest, longest = np.where(better, edits[:, j], fewest), np.where(better, lengths[j], longest)
    return at, tail, fewest, longest


def assign(f: np.ndarray, fq: np.ndarray, fn: np.ndarray, r: np.ndarray | None, rq: np.ndarray | None, rn: np.ndarray | None, d: Demux) -> dict[str, np.ndarray]:
    """Sample of each read by the barcode in it: fewest edits, then longest, then first in the sheet; -1 if none fits."""
    n = len(fn)
    out = {k: np.full(n, -1) for k in ("sample_idx", "barcode_end", "enzyme_end", "r_barcode_end", "r_enzyme_end")}
    fewest, longest, matched, over = np.full(n, K.FAR), np.zeros(n, np.int64), np.zeros(n, int), np.zeros(n, bool)
    for i, s in enumerate(d.samples):
        at, tail, edits, length = _best(f, fq, fn, s.barcode, s.enzymes, d)
        hit = at >= 0
        if r is not None and d.check_reverse:
            r_at, r_tail, _, _ = _best(r, rq, rn, *s.reverse(), d)
            hit &= r_tail >= 0
        elif r is not None:
            r_at, r_tail = np.clip(at, 0, rn), np.clip(tail, 0, rn)
        else:
            r_at = r_tail = np.full(n, -1)
        better = ~over & hit & ((edits < fewest) | (edits == fewest) & (length > longest))
        for k, v in (("sample_idx", np.full(n, i)), ("barcode_end", at), ("enzyme_end", tail), ("r_barcode_end", r_at), ("r_enzyme_end", r_tail)):
            out[k] = np.where(better, v, out[k])
        fewest, longest = np.where(better, edits, fewest), np.where(better, length, longest)
        if d.single_only:
            over |= hit & (matched >= 1)
        matched += hit
    if d.single_only:
        out["sample_idx"] = np.where(over, -1, out["sample_idx"])
    none = out["sample_idx"] < 0
    return {k: np.where(none, -1, v) for k, v in out.items()} | {"edits": np.where(none, -1, fewest)}


def assign_by_index(i1: np.ndarray, q1: np.ndarray, n1: np.ndarray, i2: np.ndarray | None, q2: np.ndarray | None, n2: np.ndarray | None, d: Demux) -> dict[str, np.ndarray]:
    """Sample of each read by the barcode in its index read: fewest edits, then the larger end, then first in the sheet."""
    n = len(n1)
    sample, best_end, fewest = np.full(n, -1), np.full(n, -1), np.full(n, K.FAR)
    matched, over = np.zeros(n, int), np.zeros(n, bool)

    def end_of(t: np.ndarray, q: np.ndarray, m: np.ndarray, barcode: str, start: int, how: K.Search) -> tuple[np.ndarray, np.ndarray]:
        seq = barcode.upper().encode()
        size = len(seq) + d.how.slack(len(seq))
        if d.how.prior is not None:
            end = K.best_posterior(t[:, : start + size], q[:, : start + size], np.minimum(m, start + size), seq, d.how, start)
            return end, np.where(end >= 0, 0, K.FAR)
        w, _, stop = _window(t, q, m, start, size)
        edits, _ = K.edits_at_ends(w, stop, seq, how, start)
        end = K.fewest(edits, last=False)
        return end, edits.min(axis=1, initial=K.FAR)

    for i, s in enumerate(d.samples):
        end, edits = end_of(i1, q1, n1, s.barcode, 0, d.how)
        hit = ~over & (end >= 0)
        ok = hit
        if i2 is not None and d.check_reverse:
            there, _ = end_of(i2, q2, n2, s.reverse()[0], d.index_offset, K.Search(d.how.budget, d.how.indels, K.FULL, d.how.wildcard))
            ok = hit & (there >= 0)
        better = ok & ((edits < fewest) | (edits == fewest) & (end + 1 > best_end))
        sample, best_end, fewest = np.where(better, i, sample), np.where(better, end + 1, best_end), np.where(better, edits, fewest)
        if d.single_only:
            over |= hit & (matched >= 1)
        matched += hit
    if d.single_only:
        sample = np.where(over, -1, sample)
    none = sample < 0
    blank = np.full(n, -1)
    return {"sample_idx": sample, "barcode_end": np.where(none, -1, best_end), "enzyme_end": blank, "r_barcode_end": blank, "r_enzyme_end": blank, "edits": np.where(none, -1, fewest)}


def demux(df: DataFrame, d: Demux, seq: str = "f_seq", qual: str = "f_qual", r_seq: str | None = None, r_qual: str | None = None) -> DataFrame:
    """`df` with sample, sample_idx, barcode_end, enzyme_end (bases up to there), the same for the reverse read, and edits; null without a sample."""
    inputs = [seq, qual, *([r_seq, r_qual] if r_seq else [])]

    def kernel(cols: list[pa.Array]) -> list[pa.Array]:
        mats = [K.to_matrix(c) for c in cols]
        f, fq, fn = K.upper(mats[0][0]), _pad(mats[1][0], mats[0][0]), mats[0][1]
        r = (K.upper(mats[2][0]), _pad(mats[3][0], mats[2][0]), mats[2][1]) if r_seq else (None, None, None)
        return columns(assign(f, fq, fn, *r, d), d)

    return add_columns(df, inputs, MATCHED, kernel)


def demux_by_index(df: DataFrame, d: Demux, seq: str = "i1_seq", qual: str | None = None, r_seq: str | None = None, r_qual: str | None = None) -> DataFrame:
    """As `demux`, by the barcodes in the index reads; nothing is asked of enzymes."""
    inputs = [seq, qual or seq, *([r_seq, r_qual or r_seq] if r_seq else [])]

    def kernel(cols: list[pa.Array]) -> list[pa.Array]:
        mats = [K.to_matrix(c) for c in cols]
        r = (K.upper(mats[2][0]), _pad(mats[3][0], mats[2][0]), mats[2][1]) if r_seq else (None, None, None)
        return columns(assign_by_index(K.upper(mats[0][0]), _pad(mats[1][0], mats[0][0]), mats[0][1], *r, d), d)

    return add_columns(df, inputs, MATCHED, kernel)


def _pad(qual: np.ndarray, seq: np.ndarray) -> np.ndarray:
    return np.pad(qual, ((0, 0), (0, max(0, seq.shape[1] - qual.shape[1]))), constant_values=33)[:, : seq.shape[1]]


def columns(found: dict[str, np.ndarray], d: Demux) -> list[pa.Array]:
    idx = found["sample_idx"]
    names = np.array([*[s.name for s in d.samples], ""], object)
    ints = [pa.array(found[k].astype(np.int32), mask=found[k] < 0) for k, _ in MATCHED[1:]]
    return [pa.array(names[idx], pa.string(), mask=idx < 0), *ints]
