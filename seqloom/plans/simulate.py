"""Seeded simulated reads with the sample that each should get, as columns over spark.range. The same seed gives the same reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.demux import Demux
from ..operators.kernels import Adapter

BASES = "ACGT"
LOWEST, QUALITIES = ord("0"), 18  # random qualities are "0" to "A"

Part = Column | str | int


def _hash(seed: int, *parts: Part) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts]))


def share(seed: int, *parts: Part) -> Column:
    """A number in [0, 1) from the seed and the parts."""
    return F.conv(F.substring(_hash(seed, *parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def between(low: Column | int, high: Column | int, seed: int, *parts: Part) -> Column:
    """A whole number from `low` to `high`."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (low + F.floor(share(seed, *parts) * (high - low + 1))).cast("int")


def random_bases(size: int, seed: int, *parts: Part) -> Column:
    blocks = [F.translate(_hash(seed, *parts, k), "0123456789abcdef", BASES * 4) for k in range(-(-size // 32))]
    return F.substring(F.concat(*blocks), 1, size) if blocks else F.lit("")


def random_quality(size: int, seed: int, *parts: Part) -> Column:
    scores = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.char(LOWEST + F.floor(share(seed, *parts, i) * QUALITIES)))
    return F.array_join(scores, "") if size else F.lit("")


def random_edits(seq: Column, edits: Column, indels: bool, seed: int, *parts: Part) -> Column:
    """`seq` after so many edits at random places: a base becomes another one, or with `indels` just as often one comes or one goes."""

    def edit(s: Column, i: Column) -> Column:
        at = F.floor(share(seed, *parts, i, "at") * F.length(s)).cast("int")
        before, old, after = F.substr(s, F.lit(1), at), F.substr(s, at + 1, F.lit(1)), F.substr(s, at + 2)
        turn = between(1, 3, seed, *parts, i, "other")
        swapped = F.concat(before, F.substr(F.lit(BASES * 2), F.position(old, F.lit(BASES)) + turn, F.lit(1)), after)
        if not indels:
            return F.when(F.length(s) > 0, swapped).otherwise(s)
        how = between(0, 2, seed, *parts, i, "how")
        new = F.substr(F.lit(BASES), between(1, 4, seed, *parts, i, "new"), F.lit(1))
        return F.when(F.length(s) == 0, s).when(how == 0, swapped).when(how == 1, F.concat(before, new, old, after)).otherwise(F.concat(before, after))

    return F.when(edits > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(edits, F.lit(1))), seq, edit)).otherwise(seq)


def _pick(values: Sequence[str], which: Column) -> Column:
    """The value at a place from 0."""
    return F.element_at(F.array(*map(F.lit, values)), which + 1)


def _beyond(most: int, seed: int, *parts: Part) -> Column:
    """A number of edits that is too large."""
    return between(most + 1, 3 * most + 1, seed, *parts)


def _head(d: Demux, side: str, which: Column, right: Column, seed: int, edits: int, indels: bool, enzyme: bool) -> tuple[Column, Column]:
    """Barcode and remnant of one read; where it isn't right, too many edits in one of them or in both."""
    k = F.col("ord")
    codes = [s.barcode if side == "f" else s.reverse()[0] for s in d.samples]
    remnants = [s.enzymes if side == "f" else s.reverse()[1] for s in d.samples]
    wrong = F.when(right, F.lit(-1)).otherwise(between(0, 2 if enzyme else 0, seed, side, "wrong", k))  # 0 barcode, 1 remnant, 2 both
    few = lambda what: between(0, edits, seed, side, what, "few", k)
    barcode = random_edits(_pick(codes, which), F.when(wrong.isin(0, 2), _beyond(edits, seed, side, "barcode", "many", k)).otherwise(few("barcode")), indels, seed, side, "barcode", k)
    if not enzyme:
        return barcode, F.lit("")
    each = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in remnants]), which + 1)
    remnant = F.element_at(each, between(1, F.size(each), seed, side, "remnant", k))
    return barcode, random_edits(remnant, F.when(wrong.isin(1, 2), _beyond(edits, seed, side, "remnant", "many", k)).otherwise(few("remnant")), indels, seed, side, "remnant", k)


def _end(adapters: Sequence[Adapter], side: str, seed: int, with_adapter: float, overlap: int, edits: int, indels: bool) -> tuple[Column, Column]:
    """What stands behind the read, and whether it is an adapter: the beginning of one with few edits; else too little of it, or too many edits."""
    k = F.col("ord")
    if not adapters:
        return F.lit(""), F.lit(False)
    seq = _pick([a.seq for a in adapters], between(0, len(adapters) - 1, seed, side, "which adapter", k))
    least = F.least(F.lit(overlap), F.length(seq))
    kind = F.when(share(seed, side, "adapter", k) >= with_adapter, F.lit(-1)).when(share(seed, side, "right adapter", k) < 0.5, F.lit(0)).otherwise(between(1, 2, seed, side, "wrong adapter", k))  # 1 short, 2 edits
    size = F.when(kind == 1, F.greatest(least - 1, F.lit(0))).otherwise(between(least, F.length(seq), seed, side, "adapter size", k))
    number = F.when(kind == 2, _beyond(edits, seed, side, "adapter", "many", k)).otherwise(between(0, edits, seed, side, "adapter", "few", k))
    shown = random_edits(F.substr(seq, F.lit(1), size), number, indels, seed, side, "adapter", k)
    return F.when(kind >= 0, shown).otherwise(F.lit("")), kind == 0


def simulate_reads(
    spark: SparkSession, n: int, d: Demux, seed: int, length: int = 100, adapter: Adapter | Sequence[Adapter] | None = None, correct: float = 0.9, with_adapter: float = 0.7, overlap: int = 3, umi: int | None = None,
    r_adapter: Adapter | Sequence[Adapter] | None = None, reverse: bool = False, check_reverse: bool = False, barcode_edits: int | None = None, barcode_indels: bool = False, adapter_edits: int = 0, adapter_indels: bool = False,
) -> DataFrame:
    """ord, header, f_seq, f_qual, with `reverse` r_seq and r_qual, with `umi` i1_seq (and i2_seq), expected, has_adapter (r_has_adapter).

    A read is a barcode and an enzyme remnant of a random sample, each with up
    to `barcode_edits` edits (by default as many as `d` allows), `length` random bases and, in a share
    `with_adapter` of the reads, an adapter's beginning: half of them with
    `overlap` bases or more and up to `adapter_edits` edits (has_adapter), half
    too short or with too many edits. In a share 1 - `correct` of the reads the
    barcode, the remnant or both have more edits than allowed; with
    `check_reverse` the same goes for reverse reads. expected is the sample, or
    Undetermined if a read of the pair is wrong; few of these may fit by chance.
    With `umi`, barcodes stand in index reads, in front of so many random
    bases, and there are no remnants.
    """
    k = F.col("ord")
    barcode_edits = d.how.budget.edits if barcode_edits is None else barcode_edits
    lists = [[] if a is None else [a] if isinstance(a, Adapter) else list(a) for a in (adapter, r_adapter)]
    which = between(0, len(d.samples) - 1, seed, "sample", k)
    right = share(seed, "right", k) < correct
    r_right = right & (share(seed, "r right", k) < correct) if check_reverse else right
    made = spark.range(n).select(F.col("id").alias("ord"), F.concat(F.lit("@sim"), "id").alias("header"))
    for side, ok, own, flag in (("f", right, lists[0], "has_adapter"), ("r", r_right, lists[1], "r_has_adapter")):
        if side == "r" and not reverse:
            break
        barcode, remnant = _head(d, side, which, ok, seed, barcode_edits, barcode_indels, umi is None)
        end, has = _end(own, side, seed, with_adapter, overlap, adapter_edits, adapter_indels)
        body = random_bases(length, seed, side, "insert", k)
        if umi is None:
            made = made.withColumn(f"{side}_seq", F.concat(barcode, remnant, body, end))
        else:
            made = made.withColumn(f"{side}_seq", F.concat(body, end)).withColumn("i1_seq" if side == "f" else "i2_seq", F.concat(barcode, random_bases(umi, seed, side, "umi", k)))
        made = made.withColumn(f"{side}_qual", F.repeat(F.lit("A"), F.length(f"{side}_seq"))).withColumn(flag, has)
    return made.withColumn("expected", F.when(r_right if reverse else right, _pick([s.name for s in d.samples], which)).otherwise(F.lit("Undetermined")))


def simulate_pairs(spark: SparkSession, n: int, seed: int, length: int = 100, overlap: int = 20, edits: int = 1) -> DataFrame:
    """ord, kind, f_seq, f_qual, r_seq, r_qual and expected (the merged read) of pairs of `length` bases with random qualities.

    kind 0, half of them: the forward read's end of `overlap` bases or more and
    the turned reverse read's beginning differ by up to `edits` substitutions.
    kind 1: they share fewer bases than `overlap`; kind 2: they differ by more.
    expected is null for both.
    """
    k = F.col("ord")
    kind = F.when(share(seed, "kind", k) < 0.5, F.lit(0)).otherwise(between(1, 2, seed, "wrong", k))
    size = F.when(kind == 1, between(1, max(1, overlap - 1), seed, "size", k)).otherwise(between(overlap, length, seed, "size", k))
    number = F.when(kind == 2, _beyond(edits, seed, "many", k)).otherwise(F.least(between(0, edits, seed, "few", k), size - 1))
    made = spark.range(n).select(F.col("id").alias("ord")).withColumn("kind", kind).withColumn("_size", size)
    own, other = (F.substr(random_bases(length, seed, what, k), F.lit(1), F.lit(length) - F.col("_size")) for what in ("f", "r"))
    common = F.substr(random_bases(length, seed, "common", k), F.lit(1), F.col("_size"))
    seen = random_edits(S.reverse_complement(common), number, False, seed, "seen", k)
    pairs = made.withColumn("f_seq", F.concat(own, common)).withColumn("f_qual", random_quality(length, seed, "f qual", k))
    pairs = pairs.withColumn("r_seq", F.concat(other, seen)).withColumn("r_qual", random_quality(length, seed, "r qual", k))
    return pairs.withColumn("expected", F.when(F.col("kind") == 0, F.concat(own, common, S.reverse_complement(other)))).drop("_size")
