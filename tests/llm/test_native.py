"""Operators with SQL: their queries against it, and edge rows against plain Python."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import imatch, line_dedup, mixing, queries, vafile
from seqloom.llm.bloom import bloom_of, bloom_positions, bloom_test

from .conftest import EDGES


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_native_plans_run_no_python(spark, sf_dir):
    for name in ("op2_imatch", "op9_mix_sources"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def plain_lines(docs, least=20, count=3):
    keys = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for i, t in docs:
        for x in (t or "").split("\n"):
            keys[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        order = lambda d: (d is not None, d or 0)
        kept = [x for x in lines if len(key(x)) < least or len(keys[key(x)]) < count or max(keys[key(x)], key=order) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_edge_rows(edges, nothing):
    got = sorted(((r["doc_id"], r["text"], r["_n_lines"], r["_n_dropped"]) for r in line_dedup.line_dedup(edges).collect()), key=str)
    assert got == plain_lines(EDGES)
    assert sum(x[3] for x in got) == 3  # two rows of one id, and one more; the largest id keeps its line
    assert line_dedup.line_dedup(nothing).count() == 0


def test_lines_at_the_thresholds(spark):
    line = "ÀÉß exactly 20 chars"
    assert len(line) == 20
    docs = [(1, line), (2, f" {line.replace('E', 'e')}\t"), (3, f"{line}\n{line}"), (4, line[1:]), (5, line[1:]), (6, line[1:]), (7, "twice only, this line"), (8, "twice only, this line"), (9, line.replace("É", "é"))]
    got = sorted((tuple(r) for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == plain_lines(docs)


def test_line_filter_that_is_full_changes_nothing(spark, monkeypatch):
    """With the smallest filters nearly everything is suspected; the exact count alone decides."""
    monkeypatch.setattr(line_dedup, "MAX_BITS", 3)
    monkeypatch.setattr(line_dedup, "MIN_BITS", 3)
    docs = [(i, "\n".join(f"line number {(i * k) % 50} of the text" for k in range(1, 9))) for i in range(60)]
    got = sorted((tuple(r) for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == plain_lines(docs)


def test_bloom_filter_has_no_false_negatives(spark):
    wanted, bits = bloom_of(spark.range(0, 5000, 5).select("id"))
    import numpy as np

    hit = bloom_test(wanted, bloom_positions(np.arange(5000), bits))
    assert hit[::5].all() and hit.mean() < 0.25


def test_fingerprint_edge_rows(edges, nothing):
    got = imatch.fingerprints(edges).collect()
    assert len(got) == len(EDGES)
    docs = sorted(((i, t or "") for i, t in EDGES), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(docs):
        after, h = docs[(k + 1) % len(docs)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    by_text = collections.defaultdict(set)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[(r["doc_id"], r["n_chars"])].add(tuple(r["hashes"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert imatch.fingerprints(nothing).count() == 0


def test_equal_texts_have_equal_fingerprints_and_edits_keep_some(spark):
    r = __import__("random").Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(80)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string")
    got = imatch.fingerprints(df, low=0.0, high=1.0).collect()
    by = collections.defaultdict(set)
    for x in got:
        by[texts[x["doc_id"] % 150]].add(tuple(x["hashes"]))
    assert all(len(v) == 1 for v in by.values())
    assert sum(x["near_edited"] for x in got) > 3 * sum(x["near_next"] for x in got)


def test_a_large_lexicon_is_joined(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(tuple(r) for r in imatch.digest(imatch.fingerprints(docs)).collect())
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    assert sorted(tuple(r) for r in imatch.digest(imatch.fingerprints(docs)).collect()) == want


def test_mixture_has_the_target_weights(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"), F.lit(1).alias("copy"))
    got = mixing.mix_sources(df, weights={"rare": 0.75, "hot": 0.25, "absent": 9.0} | {}, epochs=1.0)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert n["rare"] / n["hot"] == pytest.approx(3, rel=0.05)
    assert got.columns == ["doc_id", "source", "copy", "n_copies", "_copy", "mix_key"] and got.where("_copy > n_copies").count() == 0
    assert mixing.mix_sources(df).exceptAll(mixing.mix_sources(df)).count() == 0


def test_poisson_numbers_have_their_mean_and_variance(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3990, "a").otherwise("b").alias("source"))
    got = mixing.mix_sources(df, weights={"a": 0.5, "b": 0.5}).where("source = 'b'").groupBy("doc_id").agg(F.max("n_copies").alias("n")).collect()
    assert len(got) == 10 and sum(r["n"] for r in got) / 10 == pytest.approx(200, rel=0.12)  # a mean of 200 is the sum of 13 parts


def test_mixing_edge_rows(edges, nothing):
    got = mixing.mix_sources(edges, alpha=1.0)
    assert set(edges.columns) < set(got.columns) and got.where("_copy < 1").count() == 0
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.mix_sources(edges, weights={"none of them": 1.0}).count() == 0


def test_top_k_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [nan, 0.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (8, []), (None, [1.0, 1.0]), (9, [-0.001, 0.5]), (9, [2.0, 2.0]), (50, [1e15, -1e15]), (100, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))

    def floor(v):
        return None if v is None or any(x is None or x != x or abs(x) == inf for x in v) else [max(-(2**63), min(2**63 - 1, int((x * 256) // 1))) for x in v]

    want = sorted(_best(rows, floor, 3))
    got = sorted(tuple(r) for r in vafile.exact_top_k(df.where("vec_id % 50 = 0"), df, k=3).collect())
    assert got == want and len(want) > 6
    assert vafile.exact_top_k(df.limit(0), df).count() == 0 and vafile.exact_top_k(df, df.limit(0)).count() == 0


def test_top_k_scores_beyond_64_bits(spark):
    rows = [(0, [1e16, 1e16]), (1, [1e16, 9e15]), (2, [9e15, 1e16]), (3, [1e300, -1e300]), (4, [-1e16, -1e16]), (50, [-1e17, 1.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vafile.exact_top_k(spark.createDataFrame([rows[0], rows[5]], "vec_id long, embedding array<double>"), spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()}
    most = 2**63 - 1
    assert [got[0, r] for r in range(1, 6)] == [(1, most), (2, most), (3, -2560000000000000000), (4, -most), (50, -most)]
    assert got[50, 1] == (4, most) and len(got) == 10


@pytest.mark.parametrize("spread", [1.0, 1000.0])
def test_top_k_equals_brute_force(spark, monkeypatch, spread):
    """Several blocks, groups and chunks, a third of the vectors equal, few exact vectors read; wide values have inexact bounds."""
    for name, value in (("CANDIDATES", 64), ("CHUNK", 256), ("GROUP", 16), ("TILE", 8)):
        monkeypatch.setattr(vafile, name, value)
    r = np.random.default_rng(3)
    vectors = r.normal(0, spread, (1500, 16))
    vectors[::3] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(x) for x in vafile.exact_top_k(df.where("vec_id % 50 = 0"), df).collect())
    q = np.floor(256 * vectors).astype(np.int64)
    want = []
    for i in range(0, 1500, 50):
        scores = q @ q[i]
        order = [j for j in np.lexsort((np.arange(1500), -scores)).tolist() if j != i][:5]
        want += [(i, k + 1, j, int(scores[j])) for k, j in enumerate(order)]
    assert got == sorted(want)


def test_few_exact_vectors_are_read():
    r = np.random.default_rng(4)
    vectors = np.floor(256 * r.normal(0, 1000, (4000, 32))).astype(np.int64)
    cells, low, width = vafile.grid(vectors)
    middle, off = vafile.block_bounds(vectors[:20], low, width, cells)
    true = vectors[:20].astype(object) @ vectors.T.astype(object)
    assert (np.abs(true.astype(float) - middle) <= off[:, None]).all()
    read = 0
    for i in range(20):
        keep = vafile.best_bounds(np.zeros(4000), np.arange(4000), middle[i] - off[i], middle[i] + off[i], 5)
        keep = keep[np.argsort(-middle[i][keep], kind="stable")]
        best, n = vafile.read_in_order(vectors[i], keep, middle[i][keep] + off[i], vectors[keep], 5)
        assert [j for j, _ in best] == np.argsort(-true[i].astype(float), kind="stable")[:5].tolist()
        read += n
    assert read <= 20 * 40  # a hundredth of the vectors


def _best(rows, floor, most):
    good = [(i, floor(v)) for i, v in rows if i is not None and floor(v) is not None]
    for q, v in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:most]
            yield from ((q, k + 1, i, max(-(2**63) + 1, min(2**63 - 1, -s))) for k, (s, i) in enumerate(scored))
