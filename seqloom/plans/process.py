"""The whole run over reads as one plan: built-in predicates, one Arrow pass for what needs alignment, built-in aggregates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import dedup, demux, filters, stats
from ..operators import kernels as K
from ..operators.arrow import add_columns
from ..operators.quality import with_quality
from ..operators.trimming import quality_range
from .config import Config

TEXT = T.StringType()


def _side(s, q, n, barcode_end, enzyme_end, config: Config, adapters) -> tuple:
    """Barcode, N, quality and adapter trims of one read of each pair: bases, qualities, lengths, trimmed, adapter."""
    if barcode_end is not None and (config.trim_barcode or config.trim_enzyme):
        a, b = np.maximum(barcode_end, 0), np.maximum(enzyme_end, 0)
        if config.trim_barcode and config.trim_enzyme:
            (s, n2), (q, _) = K.cut(s, n, b, n), K.cut(q, n, b, n)
        elif config.trim_barcode:
            (s, n2), (q, _) = K.cut(s, n, a, n), K.cut(q, n, a, n)
        else:
            at = np.arange(s.shape[1])[None, :]
            gap = np.maximum(b - a, 0)
            move = np.where(at < a[:, None], at, at + gap[:, None])
            n2 = np.maximum(n - gap, 0)
            inside = at < n2[:, None]
            s, q = (np.where(inside, np.take_along_axis(x, np.minimum(move, max(s.shape[1] - 1, 0)), axis=1), 0).astype(np.uint8) for x in (s, q))
        n = n2
    start, end = K.n_trim(s, n, config.trim_n)
    (s, m), (q, _) = K.cut(s, n, start, end), K.cut(q, n, start, end)
    start, end = quality_range(s, q, m, config.quality_five, config.quality_three, config.window, config.running)
    (s, left), (q, _) = K.cut(s, m, start, end), K.cut(q, m, start, end)
    trimmed = left != m
    if adapters:
        start, end = K.adapter_range(s, q, left, list(adapters), config.adapter_search, config.adapter_offset)
        (s, n), (q, _) = K.cut(s, left, start, end), K.cut(q, left, start, end)
    else:
        n = left
    return s, q, n, trimmed, n != left


def _good(qual: np.ndarray, n: np.ndarray, config: Config) -> np.ndarray:
    """Whether the raw quality passes; an empty read has no mean, and fails."""
    if config.errors is not None:
        return K.error_sums(qual, n) <= config.errors
    return K.score_means(qual, n) >= config.quality


def transform(df: DataFrame, config: Config) -> DataFrame:
    """`df` (f_seq, f_qual, with pairs r_*, with index reads i1_* and i2_*) and what becomes of each read.

    Added: sample .. edits of the demultiplexer, out_f_seq, out_f_qual,
    out_r_seq, out_r_qual (null once merged), n_trimmed, n_adapters, merged,
    quality_ok (the filter on raw qualities).
    """
    paired, names = "r_seq" in df.columns, df.columns
    inputs = ["f_seq", "f_qual", *(["r_seq", "r_qual"] if paired else [])]
    index = [c for c in ("i1_seq", "i1_qual", "i2_seq", "i2_qual") if c in names] if config.by_index else []
    index = [c if c in names else c.replace("qual", "seq") for p in ("i1", "i2") if f"{p}_seq" in index for c in (f"{p}_seq", f"{p}_qual")]
    outputs = [*demux.MATCHED, ("out_f_seq", TEXT), ("out_f_qual", TEXT), ("out_r_seq", TEXT), ("out_r_qual", TEXT), ("n_trimmed", T.IntegerType()), ("n_adapters", T.IntegerType()), ("merged", T.BooleanType()), ("quality_ok", T.BooleanType())]
    d = config.demux

    def kernel(cols: list[pa.Array]) -> list[pa.Array]:
        mats = [K.to_matrix(c) for c in cols]
        (f, fn), fq = mats[0], demux._pad(mats[1][0], mats[0][0])
        r = (mats[2][0], demux._pad(mats[3][0], mats[2][0]), mats[2][1]) if paired else (None, None, None)
        n = len(fn)
        if d is None:
            found = {k: np.full(n, -1) for k, _ in demux.MATCHED[1:]}
        elif config.by_index:
            own = mats[4:] if paired else mats[2:]
            ix = [(K.upper(own[k][0]), demux._pad(own[k + 1][0], own[k][0]), own[k][1]) for k in range(0, len(own), 2)]
            found = demux.assign_by_index(*ix[0], *(ix[1] if len(ix) > 1 else (None, None, None)), d)
        else:
            found = demux.assign(K.upper(f), fq, fn, *((K.upper(r[0]), r[1], r[2]) if paired else r), d)
        ok = _good(*mats[1], config)
        if paired:
            ok &= _good(*mats[3], config)
        in_read = d is not None and not config.by_index
        s1, q1, n1, t1, a1 = _side(f, fq, fn, found["barcode_end"] if in_read else None, found["enzyme_end"] if in_read else None, config, config.adapters)
        trimmed, adapter, merged = t1.astype(int), a1.astype(int), np.zeros(n, bool)
        out_r = [pa.nulls(n, pa.string())] * 2
        if paired:
            s2, q2, n2, t2, a2 = _side(*r, found["r_barcode_end"] if in_read else None, found["r_enzyme_end"] if in_read else None, config, config.r_adapters)
            trimmed, adapter = trimmed + t2, adapter + a2
            if config.merge:
                before = n1 + n2
                s1, q1, n1, _ = K.merge_pairs(s1, q1, n1, s2, q2, n2, config.merge_search)
                merged = n1 != before
            else:
                out_r = [K.to_strings(s2, n2), K.to_strings(q2, n2)]
        matched = demux.columns(found, d) if d else [pa.nulls(n, pa.string()), *[pa.nulls(n, pa.int32())] * 6]
        return [*matched, K.to_strings(s1, n1), K.to_strings(q1, n1), *out_r, pa.array(trimmed.astype(np.int32)), pa.array(adapter.astype(np.int32)), pa.array(merged), pa.array(ok)]

    return add_columns(df, [*inputs, *index], outputs, kernel)


def judged(df: DataFrame, config: Config) -> DataFrame:
    """`transform` and column kept: every predicate holds. Filters on raw reads see them as they came."""
    paired = "r_seq" in df.columns
    seqs = ["f_seq", "r_seq"] if paired else ["f_seq"]
    done = transform(df, config)
    size = 2 if paired else 1
    bases = reduce(lambda a, b: a & b, [S.is_dna(c) for c in seqs])
    tests = [
        F.when(bases, F.lit(True)).otherwise(F.raise_error(F.lit("a base outside ACGTN"))) if config.strict else bases,
        filters.no_n(*seqs) if config.no_n else filters.few_n(*seqs, share=config.most_n),
        F.col("quality_ok"),
        filters.length_between("out_f_seq", least=config.least_length, most=config.most_length),
    ]
    if config.demux is not None:
        tests.append(F.col("sample").isNotNull())
    if paired and not config.merge:
        tests.append(filters.length_between("out_r_seq", least=config.least_length, most=config.most_length))
    if config.must_trim:
        tests.append(F.col("n_trimmed") == size)
    if config.must_adapter:
        tests.append(F.col("n_adapters") == size)
    if config.must_merge:
        tests.append(F.col("merged"))
    return done.withColumn("kept", F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)))


def process(df: DataFrame, config: Config) -> DataFrame:
    """One row a record: ord, sample (Undetermined for what isn't kept, Kept without a sheet), its reads as they are written, and counts.

    Undetermined records have their reads as they came. With config.dedup,
    column duplicate tells which kept records repeat a UMI; it is null where
    the index read is too short for one.
    """
    done = judged(df, config)
    paired = "r_seq" in df.columns
    kept, size = F.col("kept"), 2 if paired else 1
    pick = lambda out, raw: F.when(kept, F.col(out)).otherwise(F.col(raw))
    sample = F.when(kept, F.col("sample") if config.demux is not None else F.lit("Kept")).otherwise(F.lit("Undetermined"))
    rest = [c for c in ("f_header", "r_header", "i1_header", "i1_seq", "i1_qual", "i2_header", "i2_seq", "i2_qual") if c in df.columns]
    reads = [pick("out_f_seq", "f_seq").alias("f_seq"), pick("out_f_qual", "f_qual").alias("f_qual")]
    if paired:
        reads += [pick("out_r_seq", "r_seq").alias("r_seq"), pick("out_r_qual", "r_qual").alias("r_qual")]
    out = done.select("ord", sample.alias("sample"), "kept", *reads, *rest, F.lit(size).alias("n_reads"), *[F.when(kept, F.col(c)).otherwise(0).alias(c) for c in ("n_trimmed", "n_adapters")], F.when(kept & F.col("merged"), 2).otherwise(0).alias("n_merged"))
    bases = F.length("f_seq") + (F.coalesce(F.length("r_seq"), F.lit(0)) if paired else F.lit(0))
    out = out.withColumn("n_bases", bases)
    if config.dedup is None:
        return out.withColumn("n_duplicates", F.lit(0))
    if "i1_seq" not in df.columns:
        raise ValueError("deduplication needs index reads")
    umi = F.when(F.col("kept"), S.umi("i1_seq", config.umi))
    if config.dedup == "first":
        marked = dedup.mark_duplicates(out, umi, ["sample"], [F.col("ord")])
    else:
        quals = ["f_qual", *(["r_qual"] if paired and not config.merge else [])]
        for k, q in enumerate(quals):
            out = with_quality(out, q, f"_mean{k}", f"_errors{k}")
        errors = sum((F.col(f"_errors{k}") for k in range(len(quals))), F.lit(0.0))
        marked = dedup.mark_duplicates(out, umi, ["sample"], [errors, F.col("ord")]).drop(*[f"_{c}{k}" for k in range(len(quals)) for c in ("mean", "errors")])
    return marked.withColumn("n_duplicates", F.when(F.col("duplicate"), F.col("n_reads")).otherwise(0))


def statistics(processed: DataFrame) -> DataFrame:
    """Counts and shares by sample, with a row Total."""
    return stats.shares(stats.with_total(stats.counts(processed)))
