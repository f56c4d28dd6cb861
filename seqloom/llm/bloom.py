"""A Bloom filter of the ids of a table, of bounded size: what it lets through wrongly must be harmless."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for

PROBES = 4
MIN_BITS, MAX_BITS = 13, 28  # powers of two; beyond the larger it lets more through
SEGMENT = 17  # bytes, as a power of two
DDL = "segment int, task int, bits binary"


def bloom_positions(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64((1 << bits) - 1)).astype(np.int64)


def bloom_test(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _fill(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, own = TaskContext.get().partitionId(), np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = bloom_positions(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        size = min(len(own), 1 << SEGMENT)
        for s in range(len(own) // size):
            part = own[s * size : (s + 1) * size]
            if part.any():
                yield _row(s, task, part)

    return run


def _row(segment: int, task: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["segment", "task", "bits"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, _, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(zlib.decompress(x), np.uint8)
            got[s] = got[s] | part if s in got else part
    for s, part in got.items():
        yield _row(s, 0, part)


def bloom_of(ids: DataFrame) -> tuple[np.ndarray, int]:
    """The filter of column id (not null), and the power of two of its bits: ten bits an id, MAX_BITS at most."""
    n = partitions_for(ids.sparkSession)
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(10 * ids.count() + 1))))
    parts = ids.mapInArrow(_fill(bits), DDL)
    some = parts.repartition(n, "segment", F.col("task") % max(1, math.isqrt(n))).mapInArrow(_merge, DDL)
    whole = np.zeros(1 << (bits - 3), np.uint8)
    size = min(len(whole), 1 << SEGMENT)
    for s, _, x in some.repartition(n, "segment").mapInArrow(_merge, DDL).collect():
        whole[s * size : (s + 1) * size] = np.frombuffer(zlib.decompress(x), np.uint8)
    return whole, bits
