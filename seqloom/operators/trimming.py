"""Trims: Ns, low qualities, adapters, barcodes and enzyme remnants."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .arrow import add_columns

TEXT = T.StringType()


def _trim(df: DataFrame, seq: str, qual: str, ranges: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], flag: str | None) -> DataFrame:
    outputs = [(seq, TEXT), (qual, TEXT), *([(flag, T.BooleanType())] if flag else [])]

    def kernel(cols: list[pa.Array]) -> list[pa.Array]:
        (s, n), (q, m) = K.to_matrix(cols[0]), K.to_matrix(cols[1])
        start, end = ranges(s, q, n)
        (s2, n2), (q2, m2) = K.cut(s, n, start, end), K.cut(q, m, start, np.where(end >= n, np.maximum(m, end), end))
        return [K.to_strings(s2, n2), K.to_strings(q2, m2), *([pa.array(n2 != n)] if flag else [])]

    return add_columns(df, [seq, qual], outputs, kernel)


def n_trim(df: DataFrame, seq: str, qual: str, share: float = 0.5, flag: str | None = None) -> DataFrame:
    """Cuts Ns off both ends; see kernels.n_trim. A share above 1 cuts nothing."""
    return _trim(df, seq, qual, lambda s, q, n: K.n_trim(s, n, share), flag)


def quality_trim(df: DataFrame, seq: str, qual: str, five: int = 0, three: int = 0, window: int | None = 1, running: bool = False, flag: str | None = None) -> DataFrame:
    """Cuts low qualities off the 5' end, then off the 3' end of what is left; `flag` tells whether anything went."""

    def ranges(s: np.ndarray, q: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return quality_range(s, q, n, five, three, window, running)

    return _trim(df, seq, qual, ranges, flag)


def quality_range(s: np.ndarray, q: np.ndarray, n: np.ndarray, five: int, three: int, window: int | None, running: bool) -> tuple[np.ndarray, np.ndarray]:
    start, end = K.quality_trim(s, q, n, five, True, window, running)
    (s2, n2), (q2, _) = K.cut(s, n, start, end), K.cut(q, np.full(len(n), q.shape[1]), start, end)
    _, left = K.quality_trim(s2, q2, n2, three, False, window, running)
    return start, np.where(n2 > 0, start + left, start)


def adapter_trim(df: DataFrame, seq: str, qual: str, adapters: list[K.Adapter], how: K.Search = K.Search(overlap=3), offset: int = 0, flag: str | None = None) -> DataFrame:
    """Cuts the best adapter and all that lies beyond it; see kernels.adapter_range."""
    return _trim(df, seq, qual, lambda s, q, n: K.adapter_range(s, q, n, adapters, how, offset), flag)


def barcode_trim(text: Column, barcode_end: Column, enzyme_end: Column, barcode: bool, enzyme: bool) -> Column:
    """A read or its quality without its barcode, its enzyme remnant, or both; places are numbers of bases from the start."""
    if barcode and enzyme:
        return F.substr(text, enzyme_end + 1)
    if enzyme:
        return F.concat(F.substr(text, F.lit(1), barcode_end), F.substr(text, enzyme_end + 1))
    return F.substr(text, barcode_end + 1) if barcode else text
