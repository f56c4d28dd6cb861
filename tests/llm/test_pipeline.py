"""Every stage of the pipeline against a brute-force version on its own input."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm import queries
from seqloom.llm.langid import SWITCH, WORDS, learn_languages
from seqloom.llm.order_minhash import Text, WordIds, similar
from seqloom.llm.pipeline import LEAST_SCORE

from .conftest import EDGES
from .test_native import plain_lines
from .test_near import union_find

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows before and after each stage, over the test documents and edge rows with spare columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    odd = spark.createDataFrame([(None if i is None else i + 10**6, t, None, None, None if t is None else len(t)) for i, t in EDGES if t is None or len(t) < 10**5], docs.schema)
    top, out = tmp_path_factory.mktemp("stages"), []
    docs.unionByName(odd).withColumn("score", F.lit(1)).withColumn("key", F.col("text")).write.parquet(str(top / "in"))
    now = spark.read.parquet(str(top / "in"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf_dir).write.parquet(str(top / name.replace(" ", "")))
        after = spark.read.parquet(str(top / name.replace(" ", "")))
        out.append((now, now.collect(), after.collect()))
        now = after
    return out


def rows(found, *columns):
    return sorted((tuple(r[c] for c in columns) for r in found), key=str)


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for _, _, after in stages[:-1]:
        assert after and list(after[0].asDict()) == COLUMNS


def test_language_stage(stages):
    docs, before, after = stages[0]
    model = learn_languages(docs)

    def keeps(text):
        words = WORDS.findall((text or "").lower())
        if not words:
            return False
        scores = model.score(words).astype(float)
        v, back = scores[0], []
        for s in scores[1:]:
            top = int(v.argmax())
            jump = v < v[top] - SWITCH
            back.append(np.where(jump, top, np.arange(len(v))))
            v = np.where(jump, v[top] - SWITCH, v) + s
        labels = [int(v.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        weight = np.bincount(labels[::-1], [len(w) for w in words], len(model.langs))
        return weight.max() / weight.sum() >= LEAST_SCORE

    assert rows(after, *COLUMNS) == rows([r for r in before if keeps(r["text"])], *COLUMNS)


def test_line_stage(stages):
    _, before, after = stages[1]
    assert rows(after, "doc_id", "text") == sorted((x[:2] for x in plain_lines([(r["doc_id"], r["text"]) for r in before])), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_stage(stages):
    _, before, after = stages[2]
    ids = WordIds()
    flat = sorted({(r["doc_id"], r["text"] or "") for r in before if r["doc_id"] is not None})
    words = [Text(ids.of(t)) for _, t in flat]
    links = [(k, j) for k, (_, a) in enumerate(flat) for j in range(k) if a == flat[j][1] or len(words[k].words) and len(words[j].words) and similar(words[k], words[j]) is not None]
    root = union_find(links)
    want = [x for k, x in enumerate(flat) if root.get(k, k) == k]
    assert sorted((r["doc_id"], r["text"] or "") for r in after if r["doc_id"] is not None) == want
    assert rows([r for r in after if r["doc_id"] is None], *COLUMNS) == rows([r for r in before if r["doc_id"] is None], *COLUMNS)
    assert set(rows(after, *COLUMNS)) <= set(rows(before, *COLUMNS))


def test_mixing_stage(stages):
    _, before, after = stages[3]
    n = {}
    for r in before:
        n[r["source"]] = n.get(r["source"], 0) + 1
    weights = {k: v**0.5 for k, v in n.items()}
    want = []
    for r in before:
        rate = len(before) * weights[r["source"]] / sum(weights.values()) / n[r["source"]]
        parts, copies = max(1, math.ceil(rate / 16)), 0
        for i in range(1, parts + 1):
            u = int(hashlib.md5(f"17|{'null' if r['doc_id'] is None else r['doc_id']}|{i}".encode()).hexdigest()[:13], 16) / 2**52
            p = total = math.exp(-rate / parts)
            k = 0
            while total <= u and k < 80:
                k += 1
                p *= rate / parts / k
                total += p
                copies += 1
        want += [r] * copies
    assert rows(after, *COLUMNS) == rows(want, *COLUMNS)


def test_op9_mixes_whole_documents(spark, sf_dir):
    got = queries.op9_mix_sources(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in plan.split("Exchange hashpartitioning(mix_key")[0]  # the text itself moves
    docs = {r["doc_id"]: (r["lang"], r["source"], r["n_chars"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(docs[r["doc_id"]] == (r["lang"], r["source"], r["n_chars"], r["text_sha256"]) for r in got.collect())


def test_near_stage_keeps_different_texts_of_one_id(spark, sf_dir):
    a, b = "one two three four five six seven", "entirely other words stand here now"
    rows = [(5, a, "x"), (5, b, "x"), (6, a, "x"), (7, b, "x"), (5, a, "w"), (None, a, "x"), (8, None, "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' as source", "1 as n_chars")
    got = corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).collect()
    assert sorted(((r["doc_id"], r["text"], r["lang"]) for r in got), key=str) == sorted([(5, a, "w"), (5, b, "x"), (8, None, "x"), (None, a, "x")], key=str)


def test_encoding_stage(stages):
    _, before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in before:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), bytes(np.array(ids, "<u4").tobytes()), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in after]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_whole_run_and_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() > 0.5 * docs.count()
