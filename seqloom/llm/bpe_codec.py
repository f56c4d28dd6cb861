"""BPE encoding and decoding by batched merge rounds in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Vocabulary, chunks, merge_rounds, vocabulary
from .common import beside, column, give_back, pieces, with_columns

CACHE = 250_000  # pieces a worker remembers between batches; only speed depends on it
STEP = 1 << 20  # bytes of text whose new words share the merge rounds


class Encoder:
    """Remembers the ids of pieces; what it doesn't know yet goes through the merge rounds together."""

    def __init__(self, path: str):
        self.vocab: Vocabulary = vocabulary(path)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plans = [self._plan(t) for t in texts]
        self._learn({p for plan in plans for _, ps in plan for p in ps} - self.known.keys())
        known = self.known
        out = []
        for plan in plans:
            out.append(b"".join(special if special is not None else b"".join(map(known.__getitem__, ps)) for special, ps in plan))
        if len(known) > CACHE:
            known.clear()
        return out

    def _plan(self, text: str) -> list[tuple[bytes | None, list[str]]]:
        """Runs of pieces, each with its leading space, and special tokens' ids between them."""
        plan = []
        for part, special in self.vocab.split_special(text):
            if special:
                plan.append((self.vocab.special[part].to_bytes(4, "little"), []))
            elif part:
                plan.append((None, chunks(part)))
        return plan

    def _learn(self, new: set[str]) -> None:
        if not new:
            return
        split = {p: self.vocab.words(p) for p in new}
        words = list({w for ws in split.values() for w in ws})
        ids = dict(zip(words, (x.tobytes() for x in merge_rounds(self.vocab, [w.encode() for w in words])), strict=True))
        for p, ws in split.items():
            self.known[p] = ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws))


def _encoder(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for batch in batches:
            for a, b in pieces(batch, 0, STEP):
                part = batch.slice(a, b - a)
                ids = enc.encode([t or "" for t in part.column(0).to_pylist()])
                yield with_columns(part, names, pa.array(ids, pa.binary()))
        del enc
        give_back()

    return run


def _decoder(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary(path).token_bytes.__getitem__
        for batch in batches:
            for a, b in pieces(batch, 0, 2 * STEP):
                part = batch.slice(a, b - a)
                texts = [b"".join(map(get, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") if x else "" for x in part.column(0).to_pylist()]
                yield with_columns(part, names, pa.array(texts, pa.string()))
        give_back()

    return run


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids") -> DataFrame:
    """The columns `keep` and `out`: packed token ids (little-endian unsigned 32-bit), as the library gives them.

    Special tokens' strings in a text become their ids, which is the
    library's default; nothing is added, cut or padded. Null and empty texts
    give no ids. Rows stay where they are: no shuffle; repeated rows give
    repeated results. Columns outside `keep` are not read; `out` gets leading
    underscores where `keep` has it.
    """
    narrow, schema = beside(df.withColumn(text_col, column(df, text_col).cast("string")), text_col, keep, (out, T.BinaryType()))
    return narrow.mapInArrow(_encoder(path, schema.names), schema)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "text") -> DataFrame:
    """The columns `keep` and `out`: the text of packed ids, special tokens included; bytes that aren't UTF-8 give U+FFFD.

    Null and empty ids give an empty text. An id outside the vocabulary is an
    error. `out` gets leading underscores where `keep` has it.
    """
    narrow, schema = beside(df, ids_col, keep, (out, T.StringType()))
    return narrow.mapInArrow(_decoder(path, schema.names), schema)
