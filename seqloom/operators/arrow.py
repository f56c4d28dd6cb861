"""Kernels as DataFrame operators: one Arrow pass that adds columns and evaluates the kernel once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


CELLS = 1 << 22  # bytes of a matrix: rows times the longest read; a longer read stands alone


def pieces(batch: pa.RecordBatch, at: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts, padded to the longest, take CELLS bytes a column at most."""
    lens = np.zeros(batch.num_rows, np.int64)
    for i in at:
        if pa.types.is_string(batch.schema.field(i).type) or pa.types.is_large_string(batch.schema.field(i).type):
            lens = np.maximum(lens, pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False))
    if lens.max(initial=0) * len(lens) <= CELLS:
        yield batch
        return
    start = longest = 0
    for i, n in enumerate(lens.tolist()):
        longest = max(longest, n)
        if i > start and longest * (i + 1 - start) > CELLS:
            yield batch.slice(start, i - start)
            start, longest = i, n
    yield batch.slice(start)


def add_columns(df: DataFrame, inputs: Sequence[str], outputs: Sequence[tuple[str, T.DataType]], kernel: Callable[[list[pa.Array]], Sequence[pa.Array]]) -> DataFrame:
    """`df` and the kernel's columns, which replace columns of the same name. Rows keep their order and number.

    Kernels take a null read or quality for an empty one, and a quality that is
    shorter than its read as if scores of 0 followed. Long reads come in small
    slices, so a kernel's memory is bounded by CELLS or by one read.
    """
    names = [n for n, _ in outputs]
    kept = [f for f in df.schema.fields if f.name not in names]
    at = [df.columns.index(c) for c in inputs]
    keep_at = [i for i, f in enumerate(df.schema.fields) if f.name not in names]
    out_names = [*[f.name for f in kept], *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, at)):
            made = kernel([batch.column(i) for i in at])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep_at], *made], names=out_names)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, T.StructType([*kept, *[T.StructField(n, t) for n, t in outputs]]))
