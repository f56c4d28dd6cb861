"""Column functions on bases and qualities, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 33  # of Phred characters
MAX_PHRED = 93


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def phred_scores(qual: Column | str) -> Column:
    """The scores of a quality string, as an array; of an empty one, an empty array."""
    q = col(qual)
    return F.when(F.length(q) > 0, F.transform(F.split(q, ""), lambda c: F.ascii(c) - OFFSET)).otherwise(F.array().cast("array<int>"))


def phred_string(scores: Column | str) -> Column:
    """The quality string of an array of scores."""
    return F.array_join(F.transform(col(scores), lambda x: F.char(x + OFFSET)), "")


def count_n(seq: Column | str) -> Column:
    s = col(seq)
    return F.length(s) - F.length(F.translate(s, "Nn", ""))


def share_n(seq: Column | str) -> Column:
    """Share of Ns; of an empty read, 0."""
    s = col(seq)
    return F.when(F.length(s) > 0, count_n(s) / F.length(s)).otherwise(F.lit(0.0))


def score_sum(qual: Column | str) -> Column:
    q = col(qual)
    return F.when(F.length(q) > 0, F.aggregate(F.split(q, ""), F.lit(0), lambda a, c: a + F.ascii(c)) - OFFSET * F.length(q)).otherwise(F.lit(0))


def mean_score(qual: Column | str) -> Column:
    """Mean score; null for an empty read, so no comparison with it holds."""
    q = col(qual)
    return F.when(F.length(q) > 0, score_sum(q) / F.length(q))


def score_error(score: Column | str) -> Column:
    """Error probability of a score."""
    return F.pow(F.lit(10.0), -col(score) / 10)


def error_sum(qual: Column | str) -> Column:
    """Expected number of wrong bases."""
    q = col(qual)
    return F.when(F.length(q) > 0, F.aggregate(F.split(q, ""), F.lit(0.0), lambda a, c: a + F.pow(F.lit(10.0), (F.lit(OFFSET) - F.ascii(c)) / F.lit(10.0)))).otherwise(F.when(q.isNotNull(), F.lit(0.0)))


def error_score(error: Column | str) -> Column:
    """Score of an error probability, halves rounded up."""
    return F.floor(F.log10(col(error)) * -10 + 0.5)


def quality_char(score: Column | str) -> Column:
    return F.char(F.greatest(F.lit(0), F.least(F.lit(MAX_PHRED), col(score))) + OFFSET)


def error_char(error: Column | str) -> Column:
    return quality_char(error_score(error))


def same_error(a: Column | str, b: Column | str) -> Column:
    """Error of two equal calls of one base."""
    x, y = col(a), col(b)
    return (x * y / 3) / (1 - x - y + 4 * x * y / 3)


def different_error(a: Column | str, b: Column | str) -> Column:
    """Error of the likelier of two different calls."""
    low, high = F.least(col(a), col(b)), F.greatest(col(a), col(b))
    return low * (1 - high / 3) / (low + high - 4 * low * high / 3)


def reverse(seq: Column | str) -> Column:
    return F.reverse(col(seq))


def complement(seq: Column | str) -> Column:
    return F.translate(col(seq), "ACGTNacgtn", "TGCANtgcan")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def is_dna(seq: Column | str) -> Column:
    return col(seq).rlike("^[ATCGNatcgn]*$")


def umi(seq: Column | str, size: int) -> Column:
    """The last `size` bases of an index read, in upper case; null if it is shorter."""
    s = col(seq)
    return F.when(F.length(s) >= size, F.upper(F.substring(s, -size, size)) if size else F.lit(""))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Places in which two strings of one length differ."""
    pairs = F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def decimal_text(x: Column | str) -> Column:
    """Grouped by thousands, with seven decimals at most."""
    return F.call_function("format_number", col(x), F.lit("###,###.#######"))


def duration_text(ms: int) -> str:
    """HH:MM:SS.mmm"""
    seconds, ms = divmod(int(ms), 1000)
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{ms:03d}"
