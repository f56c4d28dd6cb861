"""Merging of overlapping read pairs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .arrow import add_columns


def merge_pairs(df: DataFrame, seq: str = "f_seq", qual: str = "f_qual", r_seq: str = "r_seq", r_qual: str = "r_qual", how: K.Search = K.Search(overlap=3), out_seq: str = "seq", out_qual: str = "qual", flag: str = "merged") -> DataFrame:
    """`df` with the merged read, or the two reads one after the other (the reverse one turned), and whether its length tells that they merged."""

    def kernel(cols: list[pa.Array]) -> list[pa.Array]:
        (s1, n1), (q1, m1), (s2, n2), (q2, m2) = map(K.to_matrix, cols)
        base, quality, total, _ = K.merge_pairs(s1, q1, n1, s2, q2, n2, how)
        return [K.to_strings(base, total), K.to_strings(quality, total), pa.array(total != n1 + n2)]

    return add_columns(df, [seq, qual, r_seq, r_qual], [(out_seq, T.StringType()), (out_qual, T.StringType()), (flag, T.BooleanType())], kernel)
