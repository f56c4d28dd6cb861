from __future__ import annotations

import pytest

EDGES = [
    (1, None), (2, ""), (3, "The same line, long enough to count.\nsecond"), (3, "The same line, long enough to count.\nsecond"), (None, "no id at all\nwith two lines"),
    (None, None), (4, "  \n\t\n"), (5, "word " * 20_000), (6, "x" * 100_000), (7, "the same LINE, long enough to count. \nother"), (8, "The same line, long enough to count."),
    (9, "ein Wort, mot, слово, 字 <|endoftext|> é́ \x00 \U0001f600"), (2**62, "a large id"), (-5, "a negative id"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns whose names the operators use themselves."""
    names = ["n_lines", "n_dropped", "ids", "score", "spans", "lang_pred", "n_tokens", "n_bytes", "over_limit", "_text", "key", "copy", "n_copies", "mix_key", "id", "digest", "x.y", "__ref", "__gone"]
    df = spark.createDataFrame([(i, t, "s" if i and i % 2 else None, None) for i, t in EDGES], "doc_id long, text string, source string, lang string")
    for n in names:
        df = df.withColumn(n, df["text"])
    return df


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
