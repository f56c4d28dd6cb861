"""Kernels against plain definitions, and worked cases."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.operators import kernels as K

DNA = st.text("ACGTN", max_size=30)


def mat(*texts: str):
    return K.to_matrix(pa.array(list(texts), pa.string()))


def strings(m, n):
    return K.to_strings(m, n).to_pylist()


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.lists(st.one_of(st.none(), st.text(max_size=9, alphabet="ACGT")), max_size=6))
def test_matrix_round_trip(texts):
    m, n = K.to_matrix(pa.array(texts, pa.string()))
    assert strings(m, n) == [t or "" for t in texts]


@settings(deadline=None)
@given(DNA, st.text("ACGTN", min_size=1, max_size=8), st.integers(1, 9), st.integers(0, 3), st.booleans())
def test_substitution_search(text, pattern, overlap, budget, wildcard):
    how = K.Search(K.Budget(budget), overlap=overlap, wildcard=wildcard)
    m, n = mat(text)
    found, length = K.edits_at_ends(m, n, pattern.encode(), how)
    least = min(overlap, len(pattern))
    for e in range(len(text)):
        k = min(e + 1, len(pattern))
        a, b = text[e - k + 1 : e + 1], pattern[len(pattern) - k :]
        edits = sum(x != y and not (wildcard and "N" in (x, y)) for x, y in zip(a, b, strict=True))
        want = edits if k >= least and edits <= budget else K.FAR
        assert found[0, e] == want and length[e] == k


@settings(deadline=None)
@given(st.text("ACGT", max_size=16), st.text("ACGT", min_size=1, max_size=6), st.integers(1, 7), st.integers(0, 2))
def test_edit_search(text, pattern, overlap, budget):
    m, n = mat(text)
    found, _ = K.edits_at_ends(m, n, pattern.encode(), K.Search(K.Budget(budget), indels=True, overlap=overlap))
    least = min(overlap, len(pattern))
    for e in range(len(text)):
        starts = [levenshtein(pattern, text[s : e + 1]) for s in range(e + 2)]
        hanging = [levenshtein(pattern[k:], text[: e + 1]) for k in range(len(pattern) - least + 1)]
        d = min(starts + hanging)
        want = d if d <= budget and min(e + 1, len(pattern)) >= least else K.FAR
        assert found[0, e] == want


def test_patterns_longer_than_a_machine_word():
    pattern = "ACGTTGCA" * 12
    m, n = mat("TT" + pattern[:50] + pattern[51:] + "GG", "")
    found, _ = K.edits_at_ends(m, n, pattern.encode(), K.Search(K.Budget(1), indels=True))
    assert found[0].min() == 1 and (found[1] == K.FAR).all()


def test_share_budget_counts_from_the_match_length():
    m, n = mat("CGGTACGT")
    found, length = K.edits_at_ends(m, n, b"AACGG", K.Search(K.Budget.of(0.3), overlap=3))
    assert K.Budget.of(0) == K.Budget(0) and K.Budget.of(2) == K.Budget(2)
    assert found[0, 2] == 0 and length[2] == 3


def test_adapters_worked_cases():
    reads = ["AAAAAAAATCGGTCA", "ATCGGTCAAAAAAAA", "AAAAAAAAAATCGGT", "CGGTCAAAAAAAAA", "AAAAAAAAAAAAAATCGGTCAAAAAAAAAAAAAAA", "AAAAAAAAAAAATC", "TCAAAAAAAAAAAA", "AAAAAAAATCCGTCA", "AAAAAAAATCGTCA", "AAAAAAAATTCGGGTC", "A" * 20]
    want = ["AAAAAAA", "", "AAAAAAAA", "CGGTCAAAAAAAAA", "AAAAAAAAAAAAA", "AAAAAAAAAAAATC", "TCAAAAAAAAAAAA", "AAAAAAA", "AAAAAAA", "AAAAAAAATTCGGGTC", "A" * 20]
    m, n = mat(*reads)
    how = K.Search(K.Budget(1), indels=True, overlap=5)
    assert strings(*K.cut(m, n, *K.adapter_range(m, m, n, [K.Adapter.three("ATCGGTCA")], how, 100))) == want


def test_merging_worked_cases():
    f = ["AAAAAAAAAAATCGGTCA", "AAAAAAAAAAATCGCTCA", "AAAAAAAAAAATCGGTCA"]
    r = ["TTTTTTTTTTTTTTTTTGACCGAT", "TTTTTTTTTTTTTTTTTGACCGAT", "TTTTTTTTTTTTTTTTTGCCCGAT"]
    (s1, n1), (s2, n2) = mat(*f), mat(*r)
    base, qual, total, _ = K.merge_pairs(s1, np.full_like(s1, 33), n1, s2, np.full_like(s2, 33), n2, K.Search(K.Budget(1), overlap=5))
    assert strings(base, total) == ["AAAAAAAAAAATCGGTCAAAAAAAAAAAAAAAAA", "AAAAAAAAAAATCGGTCAAAAAAAAAAAAAAAAA", "AAAAAAAAAAATCGGGCAAAAAAAAAAAAAAAAA"]
    assert len(strings(qual, total)[0]) == total[0]


def test_pairs_without_overlap_stand_one_after_the_other():
    (s1, n1), (s2, n2) = mat("ACGTACGTAC", "", "ACGT"), mat("CCCCCCCCCC", "ACGT", "")
    base, _, total, start = K.merge_pairs(s1, s1, n1, s2, s2, n2, K.Search(K.Budget(0), overlap=5))
    assert strings(base, total) == ["ACGTACGTACGGGGGGGGGG", "ACGT", "ACGT"] and (start == -1).all()


def test_n_trim_worked_cases():
    reads = ["NNNNATCGNNNNNN", "NNNATNNNCGNNNN", "NNANAAANNAAANA", "ATCGNNNNNNNNNATCG", "AANAAAANNAAANAANN", "NNNN", "", "nnacgtnn"]
    want = ["ATCG", "", "ANAAANNAAA", "ATCG", "AANAAAANNAAANAA", "", "", "acgt"]
    m, n = mat(*reads)
    assert strings(*K.cut(m, n, *K.n_trim(m, n, 0.5))) == want
    assert strings(*K.cut(m, n, *K.n_trim(m, n, 1.5))) == reads


def plain_n_trim(s: str, p: float) -> str:
    """The definition, base by base."""
    if not s.strip("N"):
        return ""
    f = len(s) - len(s.lstrip("N"))
    share = [(s[f : i + 1].count("N") / (i + 1), i) for i in range(f, len(s))]
    best = max((x for x in share if x[0] >= p), default=None)
    s = s[best[1] + 1 :] if best else s[f:]
    if not s.strip("N"):
        return s
    g = len(s) - len(s.rstrip("N"))
    t = s[::-1]
    share = [(t[g : i + 1].count("N") / (i + 1), i) for i in range(g, len(t))]
    best = max((x for x in share if x[0] >= p), default=None)
    cut = best[1] + 1 if best else g
    return s if cut == len(s) else s[: len(s) - cut]


@settings(max_examples=300, deadline=None)
@given(st.text("AN", max_size=14), st.sampled_from([0.1, 0.3, 0.5, 0.8]))
def test_n_trim(text, share):
    m, n = mat(text)
    assert strings(*K.cut(m, n, *K.n_trim(m, n, share))) == [plain_n_trim(text, share)]


def test_quality_trim_worked_cases():
    m, n = mat("!!!!_________!!!", "!!!-!!!---!---!!", "!!!-!!!!!!--!!!!")
    assert K.quality_trim(m, m, n, 10, False, 1, False)[1].tolist() == [13, 13, 0]


@settings(max_examples=200, deadline=None)
@given(st.text("!+5?I", min_size=1, max_size=12), st.integers(1, 30), st.booleans(), st.sampled_from([1, 2, 5, None]), st.booleans())
def test_quality_trim(qual, least, left, window, running):
    q = [ord(c) - 33 for c in qual]
    n = len(q)
    order = range(n) if left else range(n - 1, -1, -1)
    reach = n if window is None else window
    hit = None
    for i in order:
        if running:
            span = q[max(0, i - reach + 1) : i + 1] if left else q[i : i + reach]
            ok = sum(x - least for x in span) >= 0
        else:
            span = [x for x in q[max(0, i - reach) : i + reach + 1] if x <= q[i]]
            ok = sum(span) / len(span) >= least
        if ok:
            hit = i
            break
    m, size = mat(qual)
    start, end = K.quality_trim(m, m, size, least, left, window, running)
    want = (0, 0) if hit is None else (hit, n) if left else (0, hit + 1)
    assert (start[0], end[0]) == want or hit is None and start[0] == end[0]


def test_consensus_gains_and_loses():
    assert K.SAME[30, 30] > 33 + 30 and K.OTHER[30, 10] < 33 + 30


def test_likeliest_place_is_the_true_one():
    m, n = mat("AAAATGCAGAAAA", "AAAAAAAAAAAAA")
    q = np.full_like(m, 33 + 30)
    assert K.best_posterior(m, q, n, b"TGCAG", K.Search(prior=0.5)).tolist() == [8, -1]


def test_all_overlaps_of_a_small_alphabet():
    for a, b in itertools.product(["".join(x) for x in itertools.product("AC", repeat=3)], repeat=2):
        m, n = mat(a)
        found, _ = K.edits_at_ends(m, n, b.encode(), K.Search(K.Budget(3), overlap=1))
        assert found[0, 2] == sum(x != y for x, y in zip(a, b, strict=True))
