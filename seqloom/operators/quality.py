"""Quality of whole reads as columns, from the kernels: an array pass over a batch instead of a lambda call for each base."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .arrow import add_columns


def with_quality(df: DataFrame, qual: str, mean: str = "mean", errors: str = "errors") -> DataFrame:
    """`df` with the mean score (null of an empty or missing quality) and the expected wrong bases (0 of an empty one)."""

    def kernel(cols: list[pa.Array]) -> list[pa.Array]:
        q, n = K.to_matrix(cols[0])
        means = K.score_means(q, n)
        return [pa.array(means, mask=np.isnan(means)), pa.array(K.error_sums(q, n))]

    return add_columns(df, [qual], [(mean, T.DoubleType()), (errors, T.DoubleType())], kernel)
