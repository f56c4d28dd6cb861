"""Language identification: scripts narrow the candidates, Viterbi labels the spans.

A word is a run of letters. Its score for a language is the log probability of
its letter trigrams (hashed to a table of fixed size) in that language; the
script of its first letter leaves only languages that write it. Viterbi over
a text's words, with a penalty for each change of language, labels every word;
runs of equal labels are the spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside, column, give_back, pieces, with_columns

WORDS = regex.compile(r"\p{L}+")
TABLE = 1 << 18  # hashed trigrams
SMOOTH = 0.05
SWITCH = 12.0  # what a change of language costs, in natural log
FOREIGN = 30.0  # what a word costs a language that doesn't write its script
SHARE = 0.01  # of a language's letters, for a script to be one of its own
STEP = 2 << 20
CACHE = 150_000
NEW = 20_000  # words scored at once

# First code points of script ranges, and the scripts' names.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2C80, "Coptic"), (0x2E80, "Han"), (0x3040, "Hiragana"), (0x30A0, "Katakana"),
    (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3400, "Han"), (0xA000, "Yi"), (0xA4D0, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF21, "Latin"),
    (0xFF66, "Katakana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
NAMES = sorted({s for _, s in SCRIPTS})
STARTS = np.array([a for a, _ in SCRIPTS])
SCRIPT_OF = np.array([NAMES.index(s) for _, s in SCRIPTS])


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of all trigrams of all words (with a blank at both ends), each word's number of them, and its script."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.int64)
    first = np.cumsum(lens + 2) - (lens + 2)
    at = np.arange(len(flat) - 2)
    keep = np.ones(len(at), bool)
    ends = first[1:]
    keep[ends - 1] = keep[ends - 2] = False
    at = at[keep]
    mixed = flat[at] * 0x9E3779B1 + flat[at + 1] * 0x85EBCA77 + flat[at + 2] * 0xC2B2AE3D
    mixed = (mixed ^ mixed >> 15) * 0x27D4EB2F & 0xFFFFFFFFFF
    return (mixed ^ mixed >> 17) % TABLE, lens, SCRIPT_OF[np.searchsorted(STARTS, flat[first + 1], "right") - 1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language (cell >= 0) and its letters of each script (cell = -1 - script)."""
    from collections import Counter

    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words.setdefault(lang, Counter()).update(WORDS.findall((text or "").lower()))
    for lang, found in words.items():
        if not found:
            continue
        cell, lens, script = codes(list(found))
        n = np.fromiter(found.values(), np.int64, len(found))
        sums = np.bincount(cell, np.repeat(n, lens), TABLE)
        at = np.flatnonzero(sums)
        letters = np.bincount(script, n * lens, len(NAMES))
        used = np.flatnonzero(letters)
        cells, ns = np.concatenate([at, -1 - used]), np.concatenate([sums[at], letters[used]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int64()), pa.array(ns, pa.int64())], names=["lang", "cell", "n"])


class LanguageModel:
    """Log probabilities of hashed trigrams and the scripts of each learned language; its size doesn't depend on the corpus."""

    def __init__(self, langs: list[str], cells: np.ndarray, counts: np.ndarray):
        """Each entry is a language, a cell (a trigram's row, or -1 - script) and its count; a language may have many entries."""
        self.langs, lang = np.unique(np.array(langs, object).astype(str), return_inverse=True) if len(langs) else (np.empty(0, str), np.empty(0, np.int64))
        self.langs = [str(x) for x in self.langs]
        grams, letters = np.zeros((TABLE, len(self.langs))), np.zeros((len(NAMES), len(self.langs)))
        gram = cells >= 0
        np.add.at(grams, (cells[gram], lang[gram]), counts[gram])
        np.add.at(letters, (-1 - cells[~gram], lang[~gram]), counts[~gram])
        total = grams.sum(axis=0)
        self.table = np.log((grams + SMOOTH) / (total + SMOOTH * TABLE)).astype(np.float32)
        own = letters >= SHARE * letters.sum(axis=0)
        own[~own.any(axis=1)] = True  # a script that no language writes tells nothing
        self.foreign = np.where(own, 0, -FOREIGN).astype(np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """Log scores of each word for each language."""
        cell, lens, script = codes(words)
        if not len(words):
            return np.empty((0, len(self.langs)), np.float32)
        return np.add.reduceat(self.table[cell], np.cumsum(lens) - lens, axis=0) + self.foreign[script]


def learn_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000) -> LanguageModel:
    """A model of the labelled rows of `df`: about `per_language` whole texts a language, chosen by the hash of their ids.

    The bound holds for the sample alone; it makes the model's cost
    independent of the corpus. Rows with a null language or text teach nothing.
    """
    rows = df.select(column(df, id_col).alias("id"), column(df, text_col).cast("string").alias("text"), column(df, lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], np.empty(0, np.int64), np.empty(0, np.int64))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(11)), F.lit(1_000_000)) / 1e6
    sample = rows.where(draw < F.element_at(share, F.col("lang")))
    cells = sample.select("lang", "text").mapInArrow(_count, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = cells.toArrow()  # TABLE + scripts rows a language at most, as arrays
    return LanguageModel(found["lang"].to_pylist(), found["cell"].to_numpy(), found["n"].to_numpy())


def viterbi(scores: np.ndarray, lens: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of every word of many texts at once; `scores` holds their words one text after another."""
    starts = np.cumsum(lens) - lens
    order = np.argsort(-lens, kind="stable")
    start, n = starts[order], lens[order]
    active = np.searchsorted(-n, -np.arange(1, int(n.max(initial=0)) + 1), "right")  # texts with more than t words
    labels, best, moved = np.zeros(len(scores), np.int32), np.zeros(len(scores), np.int32), np.zeros(scores.shape, bool)
    if not len(active):
        return labels
    v = scores[start[: active[0]]].astype(np.float64)
    for t in range(1, len(active)):
        k = active[t]
        at = start[:k] + t
        now = v[:k]
        best[at] = now.argmax(axis=1)
        top = now.max(axis=1, keepdims=True) - penalty
        jump = now < top
        moved[at] = jump
        v[:k] = np.where(jump, top, now) + scores[at]
    label = v.argmax(axis=1).astype(np.int32)
    for t in range(len(active) - 1, 0, -1):
        k = active[t]
        at = start[:k] + t
        labels[at] = label[:k]
        label[:k] = np.where(moved[at, label[:k]], best[at], label[:k])
    labels[start[: active[0]]] = label
    return labels


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))


def _label(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        known: dict[str, int] = {}
        table, fill = np.empty((1024, len(model.langs)), np.float32), 0
        for batch in batches:
            for a, b in pieces(batch, 0, STEP):
                part = batch.slice(a, b - a)
                found = [WORDS.findall(t.lower()) if t else [] for t in part.column(0).to_pylist()]
                if fill > CACHE:
                    known.clear()
                    fill = 0
                new = list({w for ws in found for w in ws} - known.keys())
                if new and model.langs:
                    while fill + len(new) > len(table):
                        table = np.concatenate([table, np.empty_like(table)])
                    for k in range(0, len(new), NEW):
                        table[fill + k : fill + min(k + NEW, len(new))] = model.score(new[k : k + NEW])
                    known.update(zip(new, range(fill, fill + len(new)), strict=True))
                    fill += len(new)
                lens = np.fromiter(map(len, found), np.int64, len(found))
                pred, score, spans = ["und"] * len(found), [0.0] * len(found), [[]] * len(found)
                if model.langs and lens.sum():
                    at = np.fromiter((known[w] for ws in found for w in ws), np.int64, lens.sum())
                    letters = np.fromiter((len(w) for ws in found for w in ws), np.int64, lens.sum())
                    labels = viterbi(table[at], lens)
                    rows = np.repeat(np.arange(len(found)), lens)
                    weight = np.bincount(rows * len(model.langs) + labels, letters, len(found) * len(model.langs)).reshape(len(found), -1)
                    top = weight.argmax(axis=1)
                    cut = np.flatnonzero(np.diff(labels, prepend=-1) | np.diff(rows, prepend=-1))
                    size = np.diff(cut, append=len(labels))
                    first = np.cumsum(lens) - lens
                    spans = [[] for _ in found]
                    for c, k in zip(cut.tolist(), size.tolist(), strict=True):
                        spans[rows[c]].append((model.langs[labels[c]], int(c - first[rows[c]]), k))
                    for i in np.flatnonzero(lens).tolist():
                        pred[i], score[i] = model.langs[top[i]], float(weight[i, top[i]] / weight[i].sum())
                spans = pa.array([[{"lang": s[0], "first_word": s[1], "n_words": s[2]} for s in x] for x in spans], SPANS)
                yield with_columns(part, names, pa.array(pred, pa.string()), pa.array(score, pa.float64()), spans)
        known.clear()
        give_back()

    return run


def identify_languages(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred, score (its share of the letters) and spans (lang, first_word, n_words).

    lang_pred is the language of most letters, the first in the alphabet among
    equals; "und" with score 0 and no spans if the text is null, has no letter
    or the model knows no language. Whole texts are labelled, of any length.
    No shuffle; repeated rows give repeated results. Added names get leading
    underscores where `keep` has them.
    """
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
    narrow, schema = beside(df.withColumn(text_col, column(df, text_col).cast("string")), text_col, keep, ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("spans", T.ArrayType(span)))
    shared = df.sparkSession.sparkContext.broadcast(model)
    return narrow.mapInArrow(_label(shared, schema.names), schema)


def remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; of a null id, that of an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


__all__ = ["LanguageModel", "identify_languages", "learn_languages", "remainder", "viterbi"]
