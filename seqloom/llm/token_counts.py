"""Token counts by byte-pair merging with a heap over a linked list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import chunks, heap_count, vocabulary
from .common import beside, column, give_back, with_columns

CACHE = 300_000  # pieces a worker remembers; only speed depends on it


class Counter(dict):
    """Tokens of each piece, counted when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.vocab = vocabulary(path)
        self.word: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = 0
        for w in self.vocab.words(piece):
            if (k := self.word.get(w)) is None:
                k = self.word[w] = heap_count(self.vocab, w.encode())
            n += k
        self[piece] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > CACHE:
            self.clear()
        if len(self.word) > CACHE:
            self.word.clear()
        n = 0
        for part, special in self.vocab.split_special(text):
            if special:
                n += 1
            elif part:
                n += sum(map(self.__getitem__, chunks(part)))
        return n


def _counts(path: str, names: list[str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(0)), 0).cast(pa.int64())
            n = pa.array([counter.count(t.as_py() or "") for t in batch.column(0)], pa.int64())
            yield with_columns(batch, names, size, n, pc.greater(n, limit))
        del counter
        give_back()

    return run


def token_counts(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "n_tokens", limit: int = 512) -> DataFrame:
    """The columns `keep`, n_bytes (UTF-8), `out` (tokens as the library gives them) and over_limit (more than `limit`).

    A count is the symbols less the merges; no ids are made. Special tokens'
    strings in a text count as one token each. Null and empty texts count 0.
    No shuffle; repeated rows give repeated results. Added names get leading
    underscores where `keep` has them.
    """
    narrow, schema = beside(df.withColumn(text_col, column(df, text_col).cast("string")), text_col, keep, ("n_bytes", T.LongType()), (out, T.LongType()), ("over_limit", T.BooleanType()))
    return narrow.mapInArrow(_counts(path, schema.names, limit), schema)
