"""Approximate matching of a pattern in reads, as table-valued and as best-match columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .arrow import add_columns

MATCH = T.StructType([T.StructField("end", T.IntegerType()), T.StructField("edits", T.IntegerType()), T.StructField("length", T.IntegerType())])


def find_matches(df: DataFrame, seq: str, pattern: str, how: K.Search = K.Search(), window: int | None = None, best_only: bool = False, out: str = "matches") -> DataFrame:
    """`df` and an array of (end, edits, length) of the pattern's matches in the first `window` bases.

    end is the match's last column, from 0; length the nominal one. All
    matches by rising end, or only those with the fewest edits by falling end.
    An empty pattern matches once, at (0, 0, 0).
    """
    p = pattern.upper().encode()

    def kernel(cols: list[pa.Array]) -> list[pa.Array]:
        s, n = K.to_matrix(cols[0])
        if not p:
            row, end, edits, length = np.arange(len(n)), np.zeros(len(n), int), np.zeros(len(n), int), np.zeros(len(n), int)
        else:
            size = n if window is None else np.minimum(n, window)
            found, lengths = K.edits_at_ends(K.upper(s)[:, : int(size.max(initial=0))], size, p, how)
            ok = found < K.FAR
            if best_only:
                ok &= found == found.min(axis=1, initial=K.FAR, keepdims=True)
                row, back = np.nonzero(ok[:, ::-1])
                end = found.shape[1] - 1 - back
            else:
                row, end = np.nonzero(ok)
            edits, length = found[row, end], lengths[end]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))]).astype(np.int32)
        parts = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (end, edits, length)], ["end", "edits", "length"])
        return [pa.ListArray.from_arrays(pa.array(bounds), parts)]

    return add_columns(df, [seq], [(out, T.ArrayType(MATCH))], kernel)


def find_likeliest(df: DataFrame, seq: str, qual: str, pattern: str, prior: float = 0.5, overlap: int = K.FULL, wildcard: bool = False, window: int | None = None, out: str = "end") -> DataFrame:
    """`df` and the end of the likeliest match by posterior probability, null where a random one is as likely."""
    p, how = pattern.upper().encode(), K.Search(overlap=overlap, wildcard=wildcard, prior=prior)

    def kernel(cols: list[pa.Array]) -> list[pa.Array]:
        (s, n), (q, _) = K.to_matrix(cols[0]), K.to_matrix(cols[1])
        q = np.pad(q, ((0, 0), (0, max(0, s.shape[1] - q.shape[1]))), constant_values=33)[:, : s.shape[1]]
        end = K.best_posterior(K.upper(s), q, n if window is None else np.minimum(n, window), p, how) if p else np.zeros(len(n), int)
        return [pa.array(end.astype(np.int32), mask=end < 0)]

    return add_columns(df, [seq, qual], [(out, T.IntegerType())], kernel)
