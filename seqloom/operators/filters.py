"""Predicates on reads; a pair passes if both its reads do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def few_n(*seqs: Column | str, share: float) -> Column:
    """A share of Ns of `share` or less; above 1 everything passes."""
    return F.lit(True) if share > 1 else _all([S.share_n(s) <= share for s in seqs])


def no_n(*seqs: Column | str) -> Column:
    return _all([S.count_n(s) == 0 for s in seqs])


def mean_quality(*quals: Column | str, least: float) -> Column:
    """A mean score of `least` or more; an empty read fails."""
    return _all([F.coalesce(S.mean_score(q) >= least, F.lit(False)) for q in quals])


def expected_errors(*quals: Column | str, most: float | None) -> Column:
    """Expected wrong bases of `most` or fewer."""
    if most is None:
        raise ValueError("the expected-error filter needs a threshold")
    return _all([S.error_sum(q) <= most for q in quals])


def length_between(*seqs: Column | str, least: int = 0, most: int = 2**31 - 1) -> Column:
    return _all([F.length(S.col(s)).between(least, most) for s in seqs])
