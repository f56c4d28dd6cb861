"""Encoding, decoding and counting against the tokenizers library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqloom.llm.bpe import heap_count, merge_rounds, vocabulary
from seqloom.llm.bpe_codec import Encoder, bpe_decode, bpe_encode
from seqloom.llm.token_counts import Counter, token_counts

from .conftest import EDGES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(5)
    alphabet = "ab c\n\t'sdre 1²Ⅷé中 　\x85\x1c!*&"
    out = ["", " ", "  ", "a  b", "a b  ", "\n \n", "x \n y", "it's we're", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b<|endo", "Ᲊ\U00010d40 ՘x", "a" * 3000, "ab" * 2000]
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(400)]
    out += ["".join(chr(r.choice([r.randint(1, 0x2FFF), r.randint(0xA000, 0xD7FF), r.randint(0x10000, 0x1FFFF)])) for _ in range(20)) for _ in range(200)]
    return out


def test_ids_equal_the_library(library):
    want = [e.ids for e in library.encode_batch(texts(), add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(PATH).encode(texts())]
    assert got == want


def test_spaces_beside_other_white_space(library):
    """Runs that mix spaces with any other white space: the run decides where tokens end, not the space."""
    r = random.Random(11)
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()] + list("\u200b\u180e\ufeff\u2060")
    words = ["x", "a", "the", "it's", "'s", "'ll", "12", "\u00e9", "\u6771\u4eac", "...", "<|endoftext|>", "Hello", "\U0001f600", "e\u0301", "\u0378", "_"]

    def piece() -> str:
        k = r.random()
        if k < 0.35:
            return " " * r.choice([1, 1, 1, 2, 3])
        if k < 0.55:
            return r.choice(blanks)
        return r.choice(words) if k < 0.95 else chr(r.choice([r.randint(0x20, 0xD7FF), r.randint(0xE000, 0x10FFFF)]))

    made = ["x \xa0 \xa0", " \xa0 \xa0", "a \xa0 \xa0 b", *["".join(piece() for _ in range(r.randint(1, 13))) for _ in range(100_000)]]
    want = [e.ids for e in library.encode_batch(made, add_special_tokens=False)]
    assert [len(x) for x in want[:3]] == [2, 1, 3]
    enc, counter = Encoder(PATH), Counter(PATH)
    wrong = [t for k in range(0, len(made), 1000) for t, ids, w in zip(made[k : k + 1000], enc.encode(made[k : k + 1000]), want[k : k + 1000], strict=True) if np.frombuffer(ids, "<u4").tolist() != w or counter.count(t) != len(w)]
    assert not wrong


def test_counts_equal_the_library(library):
    counter = Counter(PATH)
    assert [counter.count(t) for t in texts()] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts()]


def test_rounds_and_heap_agree():
    vocab = vocabulary(PATH)
    words = [b"", b"a", b"aaaa", b"aaaaa", b"hello", b"abababab", bytes(range(256))]
    assert [len(x) for x in merge_rounds(vocab, words)] == [heap_count(vocab, w) for w in words]


def test_encoder_forgets_without_changing_ids(monkeypatch):
    import seqloom.llm.bpe_codec as codec

    want = Encoder(PATH).encode(texts())
    monkeypatch.setattr(codec, "CACHE", 3)
    enc = Encoder(PATH)
    assert [enc.encode([t])[0] for t in texts()] == want


def test_edge_rows(edges, nothing, library):
    ids = bpe_encode(edges, PATH, keep=("doc_id", "ids", "x.y"))
    assert ids.columns == ["doc_id", "ids", "x.y", "_ids"]
    rows = ids.collect()
    assert sorted(len(r["_ids"]) // 4 for r in rows) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in EDGES)
    text = bpe_decode(ids, PATH, ids_col="_ids", keep=("doc_id",))
    assert sorted(r["text"] for r in text.collect()) == sorted(t or "" for _, t in EDGES)
    assert bpe_encode(nothing, PATH).count() == 0 and token_counts(nothing, PATH).count() == 0
    counted = token_counts(edges, PATH, keep=("doc_id", "n_bytes")).collect()
    assert sorted(r["_n_bytes"] for r in counted) == sorted(len((t or "").encode()) for _, t in EDGES)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in counted)


def test_decoding_ids_that_break_utf8(spark, library):
    ids = [10, 9999, 220, 50256, 187, 163]
    df = spark.createDataFrame([(1, np.array(ids, "<u4").tobytes()), (2, None), (3, b"")], "doc_id long, ids binary")
    got = {r["doc_id"]: r["text"] for r in bpe_decode(df, PATH).collect()}
    assert got == {1: library.decode(ids, skip_special_tokens=False), 2: "", 3: ""}
