"""Near duplicates: alignment, sketches, components and classes against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from seqloom.llm import order_minhash
from seqloom.llm.components import components
from seqloom.llm.order_minhash import Text, WordIds, band_values, banded_distance, near_duplicates, near_links, order_sketch, similar


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        k = r.randrange(len(words) + 1)
        what = r.random()
        if what < 0.4 and words:
            words[min(k, len(words) - 1)] = r.choice(vocabulary)
        elif what < 0.7 and words:
            words.pop(min(k, len(words) - 1))
        else:
            words.insert(k, r.choice(vocabulary))
    return words


def test_banded_distance_is_the_edit_distance():
    r = random.Random(1)
    for _ in range(1500):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 20))]
        b = edited(r, a, r.randint(0, 6), [0, 1, 2, 3]) if r.random() < 0.6 else [r.randint(0, 3) for _ in range(r.randint(0, 20))]
        d = levenshtein(a, b)
        for limit in (0, 1, 3, 8, 30):
            assert banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), limit) == (d if d <= limit else None)


def test_similar_finds_all_pairs_from_the_threshold_on():
    r = random.Random(2)
    for _ in range(600):
        a = [r.randint(0, 60) for _ in range(r.randint(1, 60))]
        b = edited(r, a, r.randint(0, 16), range(60))
        if r.random() < 0.2:
            k = r.randrange(len(b) + 1)
            b = b[k:] + b[:k]
        true = 1 - levenshtein(a, b) / max(len(a), len(b))
        found = similar(Text(np.array(a, np.uint32)), Text(np.array(b, np.uint32)))
        assert (found is not None) == (true >= 0.8 - 1e-9) and (found is None or found <= true + 1e-9)


def test_sketches_tell_order_and_repeats():
    words = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    agree = lambda a, b: int((order_sketch(a) == order_sketch(b)).sum())
    assert agree(words, words) == 96  # sixteen orders, six pairs of four minima each
    assert agree(words, np.concatenate([words[50:], words[:50]])) < 80
    assert agree(words, words[::-1].copy()) == 0
    assert [len(order_sketch(words[:n])) for n in (1, 5, 6, 7, 8, 100)] == [16, 16, 16, 48, 96, 96]


def union_find(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: v for k, v in union_find([x for x in links if x[0] != x[1]]).items() if k != v}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(40, 160))]
        for _ in range(r.randint(1, 6)):
            texts.append(" ".join(edited(r, base, r.randint(0, len(base) // 14), vocabulary)))
        texts.append(" ".join(base[: len(base) // 2] + [r.choice(vocabulary) for _ in range(len(base) // 2)]))
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts += [" ".join(r.choice(vocabulary) for _ in range(120)) + " " + passage for _ in range(30)]
    texts += texts[:10]
    r.shuffle(texts)
    words = [t.split() for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if abs(len(words[i]) - len(words[j])) <= 0.2 * max(len(words[i]), len(words[j])) and 1 - levenshtein(words[i], words[j]) / max(len(words[i]), len(words[j])) >= 0.8]
    want = {i: i for i in range(len(texts))} | union_find(links)
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def classes_of(df):
    return {x["doc_id"]: x["class_id"] for x in near_duplicates(df).collect()}


def test_texts_meet_beside_a_hub_below_the_threshold(spark):
    rows, want = [], {}
    for g in range(0, 60, 3):
        hub = [f"h{g}.{i}" for i in range(200)]
        b = hub[:156] + [f"b{g}.{i}" for i in range(44)]  # 0.78
        c = [*b[:-1], "other"]
        rows += [(g, " ".join(hub)), (g + 1, " ".join(b)), (g + 2, " ".join(c))]
        want |= {g: g, g + 1: g + 1, g + 2: g + 1}
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == want


def test_triples_with_a_dissimilar_leader(spark):
    """b is a with its last 22 or 25 % shuffled, c is b with one word changed: b and c are one class, whatever a is."""
    r = random.Random(8)
    rows, pairs = [], []
    for g in range(200):
        a = [f"{g}.{i}" for i in range(r.randint(150, 400))]
        k = int(len(a) * (0.22 if g % 2 else 0.25))
        b = a[:-k] + r.sample(a[-k:], k)
        c = list(b)
        c[r.randrange(len(c))] = "changed"
        rows += [(3 * g + i, " ".join(x)) for i, x in enumerate((a, b, c))]
        pairs.append((3 * g, a, b, c))
    got = classes_of(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    alike = lambda x, y: 1 - levenshtein(x, y) / len(x) >= 0.8
    for i, a, b, c in pairs[:40]:
        assert got[i + 2] == got[i + 1] == (i if alike(a, b) or alike(a, c) else i + 1)
    assert all(got[i + 1] == got[i + 2] for i, *_ in pairs)


@pytest.mark.parametrize("block", [2000, 7])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, block):
    """Three hundred texts of many lengths hold one passage; a few of them are alike. Blocks of seven texts give the same classes."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(80)]
    texts = []
    for g in range(150):
        own = [f"{g}.{i}" for i in range(r.randint(30, 150))]
        near = list(own)
        for k in r.sample(range(len(own)), (len(own) + 80) // 6):
            near[k] = "x"
        texts += [own + passage, near + passage]
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string").repartition(4)
    whole = [Text(WordIds().of(" ".join(x))) for x in texts]
    want = {i: i for i in range(300)} | union_find([(i, j) for i in range(300) for j in range(i) if similar(whole[i], whole[j]) is not None])
    assert len(set(want.values())) < 200
    assert classes_of(docs) == want


@pytest.mark.parametrize("crowd", [0, 60])
def test_texts_that_meet_only_beside_a_leader_are_compared(spark, crowd):
    """t and u share bands 0 to 3 alone, which the leader (and a crowd of its copies) shares too."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(100)]
    t, u = base[:76] + [f"t{i}" for i in range(24)], base[:76] + [f"t{i}" for i in range(20)] + ["u"] * 4
    texts = [base, t, u, *[[*base[:50], f"c{k}", *base[51:]] for k in range(crowd)]]
    ids, shared, rows = WordIds(), r.integers(0, 1 << 63, 4, np.uint64), []
    for i, words in enumerate(texts):
        w = ids.of(" ".join(words))
        sketch = np.concatenate([shared, r.integers(0, 1 << 63, 28, np.uint64)]).astype("<u8")
        rows.append((i, i.to_bytes(16), len(w), sketch.tobytes()))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "id long, text string")
    links = near_links(docs, spark.createDataFrame(rows, "id long, digest binary, n int, sketch binary").coalesce(1))
    root = union_find([(x["a"], x["b"]) for x in links.collect()])
    assert root.get(2) == 1 and all(root[i] == 0 for i in range(3, len(texts))) and root.get(0, 0) == 0


def test_scattered_edits_down_to_the_threshold_meet():
    """Shares of pairs with a common band value, where a fifth of the words is replaced at random places."""
    r = random.Random(6)
    values = lambda words: set(band_values(WordIds().of(" ".join(words))).tolist())
    nine = [f"n{i}" for i in range(9)]
    assert values(nine) & values([*nine[:4], "x", *nine[5:]])
    for n, least in ((5, 1), (10, 1), (20, 1), (40, 1), (45, 0.98), (50, 0.98), (60, 0.94), (200, 0.96), (1000, 0.96)):
        met = 0
        for g in range(150):
            a = [f"{g}.{i}" for i in range(n)]
            b = list(a)
            for i in r.sample(range(n), n // 5):
                b[i] = f"x{i}"
            met += bool(values(a) & values(b))
        assert met >= least * 150, (n, met)


def test_edge_rows(edges, nothing):
    got = sorted((tuple(r) for r in near_duplicates(edges).collect()), key=str)
    classes = dict(x for x in got if x[0] is not None)
    assert len(got) == edges.count() and [x for x in got if x[0] is None] == [(None, None)] * 2
    assert classes[2] == classes[1] == 1  # null and empty texts are equal
    assert classes[3] == classes[7] == classes[8] == 3 and classes[4] == 4  # a word of eight differs
    assert near_duplicates(nothing).count() == 0


def test_an_id_with_several_texts_is_one_class(spark):
    a, b = "one two three four five six seven", "entirely other words stand here now"
    rows = [(5, a), (5, b), (6, a), (7, b), (8, "nothing of the kind, at all, anywhere")]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8}
