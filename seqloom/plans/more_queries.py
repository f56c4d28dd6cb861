"""Registered queries of files, posteriors, whole runs with all their counts, the report and the simulator; they join those of `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dedup, demux, merging, stats, trimming
from ..operators.kernels import Adapter, Budget, Search
from ..sources import fastq
from ..sources.scratch import scratch
from . import queries as Q
from .config import Config
from .process import process, statistics
from .queries import ADAPTER, ONE, REMNANT, RUN, SELECTS, SHEET, ends_sql, query, reads, run_all, sample_sql, samples
from .simulate import simulate_reads

# --- files ------------------------------------------------------------------------------------------------------------


def lots(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "header", "f_seq", "f_qual").select((F.col("ord") % 3).cast("string").alias("lot"), "ord", "header", F.col("f_seq").alias("seq"), F.col("f_qual").alias("qual"))


def written_lots(name: str, gz: bool) -> None:
    """Reads written to a folder for each lot, and read again in splits."""

    @query(name, "SELECT CAST(ord % 3 AS VARCHAR) AS lot, row_number() OVER (PARTITION BY ord % 3 ORDER BY ord) - 1 AS ord, header, f_seq AS seq, f_qual AS qual FROM reads")
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = scratch(spark, name)
        fastq.write_fastq(lots(spark, d), path, ["lot"], gz=gz)
        return fastq.read_written(spark, path, "lot").select(F.col("lot").cast("string").alias("lot"), "ord", "header", "seq", "qual")


written_lots("fastq_round_trip", False)
written_lots("fastq_gzip_round_trip", True)


def one_file(df: DataFrame, path: str, seq: str, qual: str, gz: bool = False) -> str:
    """The reads in one file in the order of ord, as sequencers deliver them; its path."""
    text = df.select("ord", fastq.fastq_record(F.concat(F.lit("@r"), "ord"), F.col(seq), F.col(qual)).alias("value"))
    text.repartition(1).sortWithinPartitions("ord").select("value").write.option("compression", "gzip" if gz else "none").text(path)
    names = [r["path"] for r in df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect()]
    return names[0]


@query("fastq_source_scan", "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, header, f_seq AS seq, f_qual AS qual FROM reads")
def fastq_source_scan(spark: SparkSession, d: str) -> DataFrame:
    """By format("fastq"), of a gzip file."""
    path = one_file(reads(spark, d, "f_seq", "f_qual"), scratch(spark, "source"), "f_seq", "f_qual", gz=True)
    return fastq.read_fastq(spark, path.removeprefix("file:"))


@query("fastq_pair_and_index_scan", "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, header AS f_header, f_seq, r_seq, r_qual, i1_seq FROM reads")
def fastq_pair_and_index_scan(spark: SparkSession, d: str) -> DataFrame:
    """Forward, reverse and index files side by side."""
    every = reads(spark, d, "f_seq", "f_qual", "r_seq", "r_qual", "i1_seq").withColumn("i1_qual", F.col("i1_seq"))
    files = [fastq.read_fastq_text(spark, one_file(every, scratch(spark, m), f"{m}_seq", f"{m}_qual", gz=m == "r")) for m in ("f", "r", "i1")]
    return fastq.join_files(*files).select("ord", "f_header", "f_seq", "r_seq", "r_qual", "i1_seq")


@query("sample_sheet_scan", "SELECT * FROM (VALUES ('S0', 'ACGTAC', 'PSTI', 'PSTI', NULL), ('S1', 'TTGCCA', 'APEKI', 'PSTI', 'GGATCT'), ('S2', 'CATGAG', NULL, NULL, NULL)) t(name, barcode, enzyme, r_enzyme, r_barcode)")
def sample_sheet_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "sheet")
    spark.createDataFrame([("S0 acgtac\tPstI",), ("  S1  TTGCCA ApeKI PstI GGATCT",), ("",), ("S2\tCATGAG",)], "value string").write.text(path)
    return fastq.read_sample_sheet(spark, path)


_NAMED = "named AS (SELECT ran.*, header FROM ran JOIN reads r ON r.ord = ran.ord)"


@query("demux_sinks", "SELECT sample, row_number() OVER (PARTITION BY sample ORDER BY ord) - 1 AS ord, header, seq FROM named", f"{Q._RUN_SQL}, {_NAMED}")
def demux_sinks(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each sample that occurs and one for undetermined reads, which stay as they came."""
    path = scratch(spark, "samples")
    fastq.write_fastq(process(reads(spark, d, "f_seq", "f_qual").withColumn("f_header", F.concat(F.lit("@r"), "ord")), RUN), path, ["sample"], "f_header", "f_seq", "f_qual")
    return fastq.read_written(spark, path, "sample").select("sample", "ord", "header", "seq")


_AGAIN = "again AS (SELECT *, row_number() OVER (PARTITION BY right(i1_seq, 12) ORDER BY ord) AS n FROM reads)"


def marked(spark: SparkSession, d: str) -> DataFrame:
    found = reads(spark, d, "header", "f_seq", "f_qual", "r_seq", "r_qual", "i1_seq").withColumn("lot", F.lit("all"))
    return dedup.mark_duplicates(found, S.umi("i1_seq", 12), [], [F.col("ord")])


@query("dedup_sink", "SELECT 'all' AS lot, row_number() OVER (ORDER BY ord) - 1 AS ord, header, f_seq AS seq FROM again WHERE n = 1", _AGAIN)
def dedup_sink(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "dedup")
    fastq.write_fastq(marked(spark, d).where("not duplicate"), path, ["lot"], "header", "f_seq", "f_qual", gz=True)
    return fastq.read_written(spark, path, "lot").select("lot", "ord", "header", "seq")


@query("duplicate_pairs_sink", "SELECT 'all' AS lot, row_number() OVER (ORDER BY ord, mate) - 1 AS ord, seq FROM (SELECT ord, 0 AS mate, f_seq AS seq FROM again WHERE n > 1 UNION ALL SELECT ord, 1, r_seq FROM again WHERE n > 1)", _AGAIN)
def duplicate_pairs_sink(spark: SparkSession, d: str) -> DataFrame:
    """Forward and reverse reads one after the other."""
    path = scratch(spark, "dup")
    fastq.write_pairs(marked(spark, d).where("duplicate").withColumn("f_header", F.col("header")).withColumn("r_header", F.col("header")), path, ["lot"], gz=True)
    return fastq.read_written(spark, path, "lot").select("lot", "ord", "seq")


# --- filters of a run, UMIs -------------------------------------------------------------------------------------------


@query("must_trim_run", f"SELECT t.ord, seq FROM ({SELECTS['quality_trim_local_3p']}) t JOIN reads r ON r.ord = t.ord WHERE length(seq) <> length(f_seq)")
def must_trim_run(spark: SparkSession, d: str) -> DataFrame:
    return process(reads(spark, d, "f_seq", "f_qual"), Config(quality_three=25, must_trim=True)).where("kept").select("ord", F.col("f_seq").alias("seq"))


@query("must_adapter_run", SELECTS["adapter_required"])
def must_adapter_run(spark: SparkSession, d: str) -> DataFrame:
    config = Config(adapters=(Adapter.three(ADAPTER),), adapter_search=Search(Budget(0), overlap=6), adapter_offset=1000, must_adapter=True)
    return process(reads(spark, d, "f_seq", "f_qual"), config).where("kept").select("ord", F.col("f_seq").alias("seq"))


def mates(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "m_f_seq", "m_f_qual", "r_seq", "r_qual").toDF("ord", "f_seq", "f_qual", "r_seq", "r_qual")


@query("must_merge_run", f"SELECT ord, seq FROM ({SELECTS['merge_required']}) WHERE merged", Q._TURNED)
def must_merge_run(spark: SparkSession, d: str) -> DataFrame:
    config = Config(merge=True, merge_search=Search(Budget(1), overlap=8), must_merge=True)
    return process(mates(spark, d), config).where("kept").select("ord", F.col("f_seq").alias("seq"))


@query("umi_long_enough", "SELECT ord, umi FROM (SELECT *, row_number() OVER (PARTITION BY umi ORDER BY ord) AS n FROM (SELECT ord, right(i, 12) AS umi FROM (SELECT ord, left(i1_seq, CAST(9 + ord % 9 AS INT)) AS i FROM reads) WHERE length(i) >= 12)) WHERE n = 1")
def umi_long_enough(spark: SparkSession, d: str) -> DataFrame:
    """Index reads of 9 to 17 bases: those shorter than the UMI drop out."""
    short = reads(spark, d, "i1_seq").withColumn("i1_seq", F.expr("left(i1_seq, cast(9 + ord % 9 as int))"))
    return dedup.first_read(short, "i1_seq", 12).select("ord", "umi")


# --- merged qualities and posteriors ----------------------------------------------------------------------------------


def place_sql(hits: str) -> str:
    """Merged bases and qualities, place by place, of pairs of 40 bases that overlap from base `start` on."""
    a, b = "substr(s1, CAST(i + 1 AS INT), 1)", "substr(s2, CAST(i - start + 1 AS INT), 1)"
    qa, qb = "substr(q1, CAST(i + 1 AS INT), 1)", "substr(q2, CAST(i - start + 1 AS INT), 1)"
    same = "(ea * eb / 3) / (1 - ea - eb + 4 * ea * eb / 3)"
    other = "least(ea, eb) * (1 - greatest(ea, eb) / 3) / (ea + eb - 4 * ea * eb / 3)"
    char = f"chr(CAST(33 + least(93, greatest(0, floor(-10 * log10(CASE WHEN a = b THEN {same} ELSE {other} END) + 0.5))) AS INT))"
    places = f"SELECT ord, i, start, {a} AS a, {b} AS b, {qa} AS qa, {qb} AS qb, pow(10.0, -(ascii({qa}) - 33) / 10.0) AS ea, pow(10.0, -(ascii({qb}) - 33) / 10.0) AS eb FROM ({hits}) h, unnest(range(0, 40 + start)) AS z(i)"
    base = "CASE WHEN i < start THEN a WHEN i >= 40 THEN b WHEN a = b OR ascii(qa) > ascii(qb) THEN a ELSE b END"
    qual = f"CASE WHEN i < start THEN qa WHEN i >= 40 THEN qb ELSE {char} END"
    return f"SELECT ord, string_agg({base}, '' ORDER BY i) AS seq, string_agg({qual}, '' ORDER BY i) AS qual FROM ({places}) GROUP BY ord"


_HITS = """SELECT ord, s1, q1, s2, q2, 40 - e AS start FROM (
  SELECT *, row_number() OVER (PARTITION BY ord ORDER BY e DESC, x) AS n FROM (
    SELECT ord, s1, q1, s2, q2, e, hamming(right(s1, CAST(e AS INT)), left(s2, CAST(e AS INT))) AS x FROM t, unnest(range(8, 41)) AS y(e)) WHERE x <= 1) WHERE n = 1"""


@query("merge_qualities", f"SELECT t.ord, coalesce(m.seq, s1 || s2) AS seq, coalesce(m.qual, q1 || q2) AS qual FROM t LEFT JOIN ({place_sql(_HITS)}) m ON m.ord = t.ord", Q._TURNED)
def merge_qualities(spark: SparkSession, d: str) -> DataFrame:
    pairs = reads(spark, d, "m_f_seq", "m_f_qual", "r_seq", "r_qual")
    return merging.merge_pairs(pairs, "m_f_seq", "m_f_qual", how=Search(Budget(1), overlap=8)).select("ord", "seq", "qual")


def product_sql(parts: str) -> str:
    return f"list_product(list_transform(range(1, CAST(e + 1 AS INT)), lambda i: {parts}))"


def _pair_posterior_sql(prior: float) -> str:
    same = "substr(s1, CAST(40 - e + i AS INT), 1) = substr(s2, CAST(i AS INT), 1)"
    right = "(1 - pow(10.0, -(ascii(substr(q1, CAST(40 - e + i AS INT), 1)) - 33) / 10.0)) * (1 - pow(10.0, -(ascii(substr(q2, CAST(i AS INT), 1)) - 33) / 10.0))"
    match, chance = product_sql(f"CASE WHEN {same} THEN {right} ELSE 1 - {right} END"), product_sql(f"CASE WHEN {same} THEN 0.25 ELSE 0.75 END")
    return f"""SELECT ord, s1, q1, s2, q2, 40 - e AS start FROM (
      SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(a / (a + b), 12) DESC, e) AS n FROM (
        SELECT *, {match} * {prior} AS a, {chance} * {1 - prior} AS b FROM t, unnest(range(8, 41)) AS y(e)) WHERE a > b) WHERE n = 1"""


@query("merge_posterior", f"SELECT t.ord, coalesce(m.seq, s1 || s2) AS seq FROM t LEFT JOIN ({place_sql(_pair_posterior_sql(0.1))}) m ON m.ord = t.ord", Q._TURNED)
def merge_posterior(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by the posterior of both reads' qualities."""
    pairs = reads(spark, d, "m_f_seq", "m_f_qual", "r_seq", "r_qual")
    return merging.merge_pairs(pairs, "m_f_seq", "m_f_qual", how=Search(overlap=8, prior=0.1)).select("ord", "seq")


def posterior_sql(seq: str, qual: str, pattern: str, place: str, size: str, wildcard: bool = False) -> tuple[str, str]:
    """P(bases | match) and P(bases | chance) of the last `size` bases of the pattern, the last of them at base `place`."""
    x, y = f"substr({seq}, CAST({place} - {size} + i AS INT), 1)", f"substr({pattern}, CAST(length({pattern}) - {size} + i AS INT), 1)"
    e = f"pow(10.0, -(ascii(substr({qual}, CAST({place} - {size} + i AS INT), 1)) - 33) / 10.0)"
    skip = f"WHEN {x} = 'N' OR {y} = 'N' THEN 1.0 " if wildcard else ""
    each = lambda part: f"list_product(list_transform(range(1, CAST({size} + 1 AS INT)), lambda i: {part}))"
    return each(f"CASE {skip}WHEN {x} = {y} THEN 1 - {e} ELSE {e} END"), each(f"CASE {skip}WHEN {x} = {y} THEN 0.25 ELSE 0.75 END")


def adapter_posterior_sql(prior: float, overlap: int, wildcard: bool) -> str:
    a, b = posterior_sql("t", "q", f"'{ADAPTER[::-1]}'", "e", f"least(e, {len(ADAPTER)})", wildcard)
    found = f"SELECT ord, e, {a} * {prior} AS a, {b} * {1 - prior} AS b FROM (SELECT ord, reverse(f_seq) AS t, reverse(f_qual) AS q FROM reads), unnest(range({overlap}, length(t) + 1)) AS x(e)"
    best = f"SELECT ord, e FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(a / (a + b), 12) DESC, e) AS n FROM ({found}) WHERE a > b) WHERE n = 1"
    return f"SELECT r.ord, CASE WHEN e IS NULL THEN f_seq ELSE left(f_seq, CAST(length(f_seq) - e AS INT)) END AS seq FROM reads r LEFT JOIN ({best}) b ON b.ord = r.ord"


def adapter_posterior(name: str, prior: float, wildcard: bool) -> None:
    @query(name, adapter_posterior_sql(prior, 5, wildcard))
    def run(spark: SparkSession, d: str) -> DataFrame:
        cut = trimming.adapter_trim(reads(spark, d, "f_seq", "f_qual"), "f_seq", "f_qual", [Adapter.three(ADAPTER)], Search(overlap=5, prior=prior, wildcard=wildcard), 1000)
        return cut.select("ord", F.col("f_seq").alias("seq"))


adapter_posterior("adapter_posterior", 0.5, False)
adapter_posterior("adapter_posterior_wildcard", 0.01, True)


def _demux_posterior_sql() -> str:
    bar, tail = posterior_sql("f_seq", "f_qual", "barcode", "6", "6"), posterior_sql("f_seq", "f_qual", f"'{REMNANT}'", "11", "5")
    return f"SELECT r.ord, name AS sample FROM reads r LEFT JOIN (SELECT ord, name, row_number() OVER (PARTITION BY ord ORDER BY i_) AS n FROM (SELECT ord, f_seq, f_qual, i AS i_, name, barcode FROM reads, sheet) WHERE {bar[0]} > {bar[1]} AND {tail[0]} > {tail[1]}) s ON s.ord = r.ord AND n = 1"


@query("demux_posterior", _demux_posterior_sql(), Q._SHEET_SQL)
def demux_posterior(spark: SparkSession, d: str) -> DataFrame:
    return demux.demux(reads(spark, d, "f_seq", "f_qual"), demux.Demux(samples(), Search(prior=0.5))).select("ord", "sample")


@query("quality_chars", "SELECT CAST(id AS BIGINT) AS id, CAST(floor(-10 * log10(id / 500.0) + 0.5) AS BIGINT) AS score, chr(CAST(33 + least(93, greatest(0, floor(-10 * log10(id / 500.0) + 0.5))) AS INT)) AS char FROM range(1, 700) t(id)")
def quality_chars(spark: SparkSession, d: str) -> DataFrame:
    error = F.col("id") / F.lit(500.0)
    return spark.range(1, 700).select("id", S.error_score(error).cast("long").alias("score"), S.error_char(error).alias("char"))


def number_sql(x: str) -> str:
    """A number below 1 that isn't negative, with seven decimals at most."""
    return f"rtrim(rtrim(printf('%.7f', {x}), '0'), '.')"


@query("numbers_as_text", "SELECT CAST(id AS BIGINT) AS id, format('{:,}', CAST(floor(id * 12345.0 / 8) AS BIGINT)) || substr(rtrim(rtrim(printf('%.7f', id * 12345.0 / 8 - floor(id * 12345.0 / 8)), '0'), '.'), 2) AS number FROM range(0, 900) t(id)")
def numbers_as_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0, 900).select("id", S.decimal_text(F.col("id") * F.lit(12345.0) / 8).alias("number"))


# --- whole runs with all counts ---------------------------------------------------------------------------------------

ALL = ("reads", "bases", "merged", "adapters", "trimmed", "duplicates")
SHARES = ("share_reads", "share_merged", "share_dedup", "share_adapters", "share_trimmed", "share_bases")


def shares_sql(ran: str) -> str:
    """Counts and shares by sample, and their total, of rows with sample and n_ of each count."""
    counts = f"SELECT coalesce(sample, 'Total') AS sample, {', '.join(f'CAST(sum(n_{c}) AS BIGINT) AS {c}' for c in ALL)} FROM {ran} GROUP BY ROLLUP (sample)"
    own = {"share_dedup": "duplicates", "share_adapters": "adapters", "share_trimmed": "trimmed"}
    whole = {"share_reads": ("reads", "reads"), "share_merged": ("merged", "reads"), "share_bases": ("bases", "bases")}
    part = [f"{a} / reads AS {k}" for k, a in own.items()] + [f"{a} / max({b}) OVER () AS {k}" for k, (a, b) in whole.items()]  # the total is the greatest
    return f"SELECT sample, {', '.join(ALL)}, {', '.join(part)} FROM ({counts})"


def rounded(df: DataFrame) -> DataFrame:
    return df.select("sample", *ALL, *[F.round(c, 9).alias(c) for c in SHARES])


def shares_query(name: str, ran: str, ctes: str, config: Config, source) -> None:
    sql = f"SELECT sample, {', '.join(ALL)}, {', '.join(f'round({c}, 9) AS {c}' for c in SHARES)} FROM ({shares_sql(ran)})"

    @query(name, sql, ctes)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(statistics(process(source(spark, d), config)))


_UMI_RUN = f"""{Q._SHEET_SQL}, by_index AS ({sample_sql('i1_seq', 0, False, 1)}),
trimmed AS ({SELECTS['quality_trim_local_3p']}),
ends AS (
  SELECT ord, "end" FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY length DESC, edits, "end") AS n
    FROM ({ends_sql(ADAPTER[::-1], 't', 3, source="(SELECT ord, reverse(seq) AS t FROM trimmed)")}) WHERE edits <= 1) WHERE n = 1),
cut AS (
  SELECT r.ord, right(i1_seq, 12) AS umi, f_seq, b.sample, t.seq AS s, CASE WHEN e.ord IS NULL THEN t.seq ELSE left(t.seq, length(t.seq) - 1 - "end") END AS c
  FROM reads r JOIN trimmed t ON t.ord = r.ord LEFT JOIN by_index b ON b.ord = r.ord LEFT JOIN ends e ON e.ord = r.ord),
kept AS (SELECT *, sample IS NOT NULL AND length(c) >= 20 AS ok FROM cut),
umi_run AS (
  SELECT CASE WHEN ok THEN sample ELSE 'Undetermined' END AS sample, 1 AS n_reads, CASE WHEN ok THEN length(c) ELSE length(f_seq) END AS n_bases, 0 AS n_merged,
    CASE WHEN ok AND length(c) <> length(s) THEN 1 ELSE 0 END AS n_adapters, CASE WHEN ok AND length(s) <> length(f_seq) THEN 1 ELSE 0 END AS n_trimmed,
    CASE WHEN ok AND row_number() OVER (PARTITION BY ok, sample, umi ORDER BY ord) > 1 THEN 1 ELSE 0 END AS n_duplicates
  FROM kept)"""
UMI_RUN = Config(
    demux=demux.Demux(samples(False), ONE), by_index=True, quality_three=25, adapters=(Adapter.three(ADAPTER),), adapter_search=Search(Budget(1), overlap=3), adapter_offset=1000, least_length=20, dedup="first", umi=12
)
shares_query("run_with_umis", "umi_run", _UMI_RUN, UMI_RUN, lambda spark, d: reads(spark, d, "f_seq", "f_qual", "i1_seq"))

_MERGE_RUN = f"""{Q._TURNED}, m AS ({place_sql(_HITS)}), pairs AS (SELECT t.ord, coalesce(m.seq, s1 || s2) AS seq, m.ord IS NOT NULL AND length(m.seq) <> 80 AS merged FROM t LEFT JOIN m ON m.ord = t.ord),
merge_run AS (
  SELECT CASE WHEN ok THEN 'Kept' ELSE 'Undetermined' END AS sample, 2 AS n_reads, CASE WHEN ok THEN length(seq) ELSE 80 END AS n_bases, CASE WHEN ok AND merged THEN 2 ELSE 0 END AS n_merged, 0 AS n_adapters, 0 AS n_trimmed, 0 AS n_duplicates
  FROM (SELECT *, length(seq) BETWEEN 45 AND 60 AS ok FROM pairs))"""
shares_query("run_with_merging", "merge_run", _MERGE_RUN, Config(merge=True, merge_search=Search(Budget(1), overlap=8), least_length=45, most_length=60), mates)

_REPORT_RAN = "all_ran AS (SELECT sample, 1 AS n_reads, length(seq) AS n_bases, 0 AS n_merged, adapters AS n_adapters, 0 AS n_trimmed, 0 AS n_duplicates FROM ran)"


def _report_sql() -> str:
    title = " ".join(x.ljust(stats.WIDTH) for x in ["Sample", *[t for k, t in stats.TITLES if k != "r_barcode"]])
    rows = ", ".join(f"({n}, '{name}', '{SHEET.get(name, '')}')" for n, name in enumerate([*SHEET, "Undetermined", "Total"], 1))
    count = lambda c: f"format('{{:,}}', coalesce({c}, 0))"
    cells = ["name", "barcode"]
    for k, _ in stats.TITLES[2:]:
        c = {"dedup": "duplicates"}.get(k, k)
        cells.append(number_sql(f"coalesce({c}, 0)") if k.startswith("share") else count(c))
    line = " || ' ' || ".join(f"rpad({c}, {stats.WIDTH}, ' ')" for c in cells)
    return f"SELECT 0 AS n, '{title}' AS line UNION ALL SELECT n, {line} FROM (VALUES {rows}) k(n, name, barcode) LEFT JOIN ({shares_sql('all_ran')}) s ON s.sample = k.name"


@query("stats_report", _report_sql(), f"{Q._RUN_SQL}, {_REPORT_RAN}")
def stats_report(spark: SparkSession, d: str) -> DataFrame:
    return stats.report(statistics(run_all(spark, d)), {n: (b, None) for n, b in SHEET.items()})


# --- the simulator ----------------------------------------------------------------------------------------------------

SIM_SEED, SIM_READS, SIM_LENGTH = 11, 3000, 40
SIM_ADAPTERS = {"f": ADAPTER, "r": "CCTTGGAACCTT"}


def _simulated_sql() -> str:
    """The simulator's draws, each an MD5 of the seed and what it decides, for no edits where a read is right and one where it isn't."""

    def share(*parts) -> str:
        return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', '{SIM_SEED}', {', '.join(parts)})), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)"

    def swapped(s: str, *parts) -> str:
        at = f"CAST(floor({share(*parts, chr(39) + '1' + chr(39), chr(39) + 'at' + chr(39))} * length({s})) AS INT)"
        turn = f"CAST(1 + floor({share(*parts, chr(39) + '1' + chr(39), chr(39) + 'other' + chr(39))} * 3) AS INT)"
        return f"(left({s}, {at}) || substr('ACGTACGT', strpos('ACGT', substr({s}, {at} + 1, 1)) + {turn}, 1) || substr({s}, {at} + 2))"

    k, quote = "CAST(id AS VARCHAR)", lambda x: f"'{x}'"
    sides = []
    for side in ("f", "r"):
        draw = lambda *parts, side=side: share(quote(side), *map(quote, parts), k)
        codes = [s.barcode if side == "f" else s.reverse()[0] for s in RUN.demux.samples]
        code = "CASE which " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(codes)) + " END"
        tail = "CASE which " + " ".join(f"WHEN {i} THEN '{(s.enzymes if side == 'f' else s.reverse()[1])[0]}'" for i, s in enumerate(RUN.demux.samples)) + " END"
        wrong = f"CASE WHEN {'ok' if side == 'f' else 'r_ok'} THEN -1 ELSE CAST(floor({draw('wrong')} * 3) AS INT) END"
        bases = "substr(" + " || ".join(f"translate(md5(concat_ws('|', '{SIM_SEED}', '{side}', 'insert', {k}, '{b}')), '0123456789abcdef', 'ACGTACGTACGTACGT')" for b in range(2)) + f", 1, {SIM_LENGTH})"
        kind = f"CASE WHEN {draw('adapter')} >= 0.7 THEN -1 WHEN {draw('right adapter')} < 0.5 THEN 0 ELSE CAST(1 + floor({draw('wrong adapter')} * 2) AS INT) END"
        size = f"CAST(3 + floor({draw('adapter size')} * 10) AS INT)"
        sides.append(f"{code} AS {side}_code, {tail} AS {side}_tail, {wrong} AS {side}_wrong, {bases} AS {side}_bases, {kind} AS {side}_kind, left('{SIM_ADAPTERS[side]}', {size}) AS {side}_shown")
    out = []
    for side in ("f", "r"):
        part = lambda s, what, bad, side=side: f"CASE WHEN {bad} THEN {swapped(s, quote(side), quote(what), k)} ELSE {s} END"
        end = f"CASE {side}_kind WHEN -1 THEN '' WHEN 1 THEN '{SIM_ADAPTERS[side][:2]}' WHEN 2 THEN {swapped(f'{side}_shown', quote(side), quote('adapter'), k)} ELSE {side}_shown END"
        out.append(f"{part(f'{side}_code', 'barcode', f'{side}_wrong IN (0, 2)')} || {part(f'{side}_tail', 'remnant', f'{side}_wrong IN (1, 2)')} || {side}_bases || {end} AS {side}_seq")
    names = "CASE which " + " ".join(f"WHEN {i} THEN '{s.name}'" for i, s in enumerate(RUN.demux.samples)) + " END"
    first = f"SELECT id, CAST(floor({share(quote('sample'), k)} * {len(codes)}) AS INT) AS which, {share(quote('right'), k)} < 0.9 AS ok, {share(quote('right'), k)} < 0.9 AND {share(quote('r right'), k)} < 0.9 AS r_ok FROM range(0, {SIM_READS}) t(id)"
    second = f"SELECT id, which, r_ok, {', '.join(sides)} FROM ({first})"
    return f"SELECT CAST(id AS BIGINT) AS ord, {', '.join(out)}, CASE WHEN r_ok THEN {names} ELSE 'Undetermined' END AS expected, f_kind = 0 AS has_adapter, r_kind = 0 AS r_has_adapter FROM ({second})"


@query("simulated_reads", _simulated_sql())
def simulated_reads(spark: SparkSession, d: str) -> DataFrame:
    own = [Adapter.three(SIM_ADAPTERS[s]) for s in "fr"]
    made = simulate_reads(spark, SIM_READS, RUN.demux, SIM_SEED, SIM_LENGTH, own[0], r_adapter=own[1], reverse=True, check_reverse=True, barcode_edits=0)
    return made.select("ord", "f_seq", "r_seq", "expected", "has_adapter", "r_has_adapter")


@query("simulated_samples")
def simulated_samples(spark: SparkSession, d: str) -> DataFrame:
    """Simulated reads and what the run makes of them; tested against the samples that they were made for."""
    made = simulate_reads(spark, 5000, RUN.demux, 11, 60, Adapter.three(ADAPTER))
    return made.join(process(made, RUN).select("ord", "sample"), "ord").groupBy("expected", "sample").agg(F.count("*").alias("n"))
