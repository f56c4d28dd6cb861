"""The registered read queries over reads derived from `orders`, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dedup, demux, filters, matching, merging, quality, stats, trimming
from ..operators.kernels import FULL, Adapter, Budget, Search
from ..sources import enzymes
from .config import Config
from .process import process, statistics

# Reads as a function of the keys of `orders`: the same text gives the same rows in Spark and in DuckDB.
READS_SQL = """
with k as (select o_orderkey k, o_custkey c from {orders}),
a as (select k, c,
  substr(translate(concat(md5(concat('s',cast(k as string))),md5(concat('t',cast(k as string)))),
         '0123456789abcdef','ACGTACGTACGTACGN'),1,40) ins,
  case k%5 when 0 then 'ACGTAC' when 1 then 'TTGCCA' when 2 then 'GGATCT' when 3 then 'CATGAG'
       else substr(translate(md5(concat('b',cast(k as string))),'0123456789abcdef','ACGTACGTACGTACGT'),1,6) end bc0,
  case when k%11=0 then 'TGGAG' else 'TGCAG' end enz,
  case k%3 when 0 then 'AGATCGGAAGAGTTTT'
           when 1 then substr('AGATCGGAAGAG',1,cast(3+k%9 as int)) else '' end ad,
  substr(translate(md5(concat('m',cast(c%300 as string))),'0123456789abcdef','ACGTACGTACGTACGT'),1,12) umi,
  substr(translate(md5(concat('w',cast(k as string))),'0123456789abcdef','ACGTACGTACGTACGT'),1,20) tail from k),
b as (select *, case k%7 when 3 then concat(substr(bc0,1,2),'A',substr(bc0,4))
                         when 5 then concat(substr(bc0,1,3),substr(bc0,5)) else bc0 end bc from a),
d as (select k as ord, concat(bc,enz,ins,ad) f_seq, ins m_f_seq,
  reverse(translate(concat(case k%4 when 1 then concat(substr(ins,21,9),'A',substr(ins,31,10))
                                    when 2 then reverse(substr(ins,21,20))
                                    else substr(ins,21,20) end, tail),'ACGTN','TGCAN')) r_seq,
  concat(bc,umi) i1_seq from b)
select ord, concat('@r',cast(ord as string)) header, f_seq,
  substr(translate(concat(md5(concat('q',cast(ord as string))),md5(concat('r',cast(ord as string))),md5(concat('u',cast(ord as string)))),
         '0123456789abcdef','!#+-05:<?ADFGHIJ'),1,length(f_seq)) f_qual,
  m_f_seq,
  substr(translate(concat(md5(concat('x',cast(ord as string))),md5(concat('y',cast(ord as string)))),
         '0123456789abcdef','!#+-05:<?ADFGHIJ'),1,40) m_f_qual,
  r_seq,
  substr(translate(concat(md5(concat('v',cast(ord as string))),md5(concat('z',cast(ord as string)))),
         '0123456789abcdef','!#+-05:<?ADFGHIJ'),1,40) r_qual,
  i1_seq
from d
"""

ADAPTER = "AGATCGGAAGAG"
SHEET = {"S0": "ACGTAC", "S1": "TTGCCA", "S2": "GGATCT", "S3": "CATGAG"}
REMNANT = "TGCAG"


def reads(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    found = spark.sql(READS_SQL, orders=spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    return found.select("ord", *columns) if columns else found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SELECTS: dict[str, str] = {}  # the SQL without its CTEs
_READS = "reads AS (" + READS_SQL.format(orders="orders") + ")"


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable:
    """Registers a query, and its SQL as a SELECT over the reads (and more CTEs)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SELECTS[name] = sql
            ORACLE_SQL[name] = f"WITH {_READS}{', ' + ctes if ctes else ''} {sql}"
        return f

    return add


def phred(q: str) -> str:
    return f"list_transform(string_split({q}, ''), lambda c: ascii(c) - 33)"


# --- scans, scalar functions, filters ---------------------------------------------------------------------------------


@query("scan_reads", "SELECT ord, header, f_seq, f_qual, r_seq, r_qual, i1_seq FROM reads")
def scan_reads(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "header", "f_seq", "f_qual", "r_seq", "r_qual", "i1_seq")


@query("count_n", "SELECT ord, CAST(length(f_seq) - length(replace(f_seq, 'N', '')) AS INT) AS n, round((length(f_seq) - length(replace(f_seq, 'N', ''))) / length(f_seq), 9) AS share FROM reads")
def count_n(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "f_seq").select("ord", S.count_n("f_seq").alias("n"), F.round(S.share_n("f_seq"), 9).alias("share"))


@query("share_n_filter", "SELECT ord, f_seq FROM reads WHERE (length(f_seq) - length(replace(f_seq, 'N', ''))) / length(f_seq) <= 0.05 AND (length(r_seq) - length(replace(r_seq, 'N', ''))) / length(r_seq) <= 0.05")
def share_n_filter(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "f_seq", "r_seq").where(filters.few_n("f_seq", "r_seq", share=0.05)).select("ord", "f_seq")


@query("no_n_filter", "SELECT ord, f_seq FROM reads WHERE position('N' IN f_seq) = 0")
def no_n_filter(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "f_seq").where(filters.no_n("f_seq"))


_MEANS = f"SELECT ord, round(m, 6) AS mean FROM (SELECT ord, list_sum({phred('f_qual')}) / length(f_qual) AS m FROM reads) WHERE m >= 22"
_SUMS = f"SELECT ord, round(e, 6) AS errors FROM (SELECT ord, list_sum(list_transform({phred('f_qual')}, lambda x: pow(10.0, -x / 10.0))) AS e FROM reads) WHERE e <= 6.5"


@query("mean_quality_filter", _MEANS)
def mean_quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_quality(reads(spark, d, "f_qual"), "f_qual").where("mean >= 22").select("ord", F.round("mean", 6).alias("mean"))


@query("expected_error_filter", _SUMS)
def expected_error_filter(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_quality(reads(spark, d, "f_qual"), "f_qual").where("errors <= 6.5").select("ord", F.round("errors", 6).alias("errors"))


@query("mean_quality_builtin", _MEANS)
def mean_quality_builtin(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "f_qual").where(filters.mean_quality("f_qual", least=22)).select("ord", F.round(S.mean_score("f_qual"), 6).alias("mean"))


@query("expected_error_builtin", _SUMS)
def expected_error_builtin(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "f_qual").where(filters.expected_errors("f_qual", most=6.5)).select("ord", F.round(S.error_sum("f_qual"), 6).alias("errors"))


@query("phred_by_position", f"SELECT pos, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM (SELECT unnest({phred('f_qual')}) AS score, CAST(unnest(range(0, length(f_qual))) AS INT) AS pos FROM reads) GROUP BY pos")
def phred_by_position(spark: SparkSession, d: str) -> DataFrame:
    each = reads(spark, d, "f_qual").select(F.posexplode(S.phred_scores("f_qual")).alias("pos", "score"))
    return each.groupBy("pos").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("phred_round_trip", "SELECT ord, f_qual AS qual FROM reads")
def phred_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "f_qual").select("ord", S.phred_string(S.phred_scores("f_qual")).alias("qual"))


@query("reverse_complement", "SELECT ord, reverse(translate(f_seq, 'ACGT', 'TGCA')) AS rc, translate(f_seq, 'ACGT', 'TGCA') AS comp, reverse(f_seq) AS rev FROM reads")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "f_seq").select("ord", S.reverse_complement("f_seq").alias("rc"), S.complement("f_seq").alias("comp"), S.reverse("f_seq").alias("rev"))


@query("length_filter", "SELECT ord, CAST(length(f_seq) AS INT) AS n FROM reads WHERE length(f_seq) BETWEEN 52 AND 60")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d, "f_seq").where(filters.length_between("f_seq", least=52, most=60)).select("ord", F.length("f_seq").alias("n"))


@query(
    "consensus_quality",
    """SELECT a, b,
      round((ea * eb / 3) / (1 - ea - eb + 4 * ea * eb / 3), 9) AS same,
      round(least(ea, eb) * (1 - greatest(ea, eb) / 3) / (ea + eb - 4 * ea * eb / 3), 9) AS other
    FROM (SELECT CAST(x AS INT) AS a, CAST(y AS INT) AS b, pow(10.0, -x / 10.0) AS ea, pow(10.0, -y / 10.0) AS eb FROM range(1, 42) s(x), range(1, 42) t(y))""",
)
def consensus_quality(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(1, 42).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(41))).alias("b"))
    ea, eb = S.score_error(F.col("a").cast("double")), S.score_error(F.col("b").cast("double"))
    return grid.select("a", "b", F.round(S.same_error(ea, eb), 9).alias("same"), F.round(S.different_error(ea, eb), 9).alias("other"))


# --- trims ------------------------------------------------------------------------------------------------------------


def local_sql(q: str, least: int, window: int) -> str:
    """Whether each base passes the local-average test."""
    return f"list_transform(range(1, len({q}) + 1), lambda i: list_avg(list_filter({q}[CAST(greatest(i - {window}, 1) AS INT):CAST(least(i + {window}, len({q})) AS INT)], lambda x: x <= {q}[CAST(i AS INT)])) >= {least})"


def running_sql(q: str, least: int, window: int) -> str:
    return f"list_transform(range(1, len({q}) + 1), lambda i: list_sum({q}[CAST(greatest(i - {window} + 1, 1) AS INT):CAST(i AS INT)]) - {least} * least(i, {window}) >= 0)"


def trim_query(name: str, five: int, three: int, window: int, running: bool) -> None:
    rule = running_sql if running else local_sql
    q = phred("f_qual")
    after5 = f"CASE WHEN {five} = 0 THEN f_seq ELSE coalesce(substr(f_seq, nullif(list_position({rule('q', five, window)}, true), 0)), '') END" if five else "f_seq"
    if running:  # the 3' end by the mirrored list
        back = f"coalesce(left(s, len(p) - nullif(list_position({rule('list_reverse(p)', three, window)}, true), 0) + 1), '')"
    else:
        back = f"coalesce(left(s, len(p) - nullif(list_position(list_reverse({rule('p', three, window)}), true), 0) + 1), '')"
    last = back if three else "s"
    sql = f"""SELECT ord, {last} AS seq FROM (
      SELECT ord, s, CASE WHEN length(s) = 0 THEN CAST([] AS INT[]) ELSE q[length(f_seq) - length(s) + 1:] END AS p FROM (
        SELECT ord, f_seq, q, {after5} AS s FROM (SELECT ord, f_seq, {q} AS q FROM reads)))"""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        cut = trimming.quality_trim(reads(spark, d, "f_seq", "f_qual"), "f_seq", "f_qual", five, three, window, running)
        return cut.select("ord", F.col("f_seq").alias("seq"))


trim_query("quality_trim_local_5p", 25, 0, 1, False)
trim_query("quality_trim_local_3p", 0, 25, 1, False)
trim_query("quality_trim_local_both", 28, 28, 2, False)
trim_query("quality_trim_sum_5p", 25, 0, 1000, True)
trim_query("quality_trim_sum_3p", 0, 25, 1000, True)
trim_query("quality_trim_sum_window", 25, 25, 4, True)


def n_trim_query(name: str, share: float) -> None:
    part = lambda s: f"""list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i > f THEN (length(substr({s}, f + 1, i - f)) - length(replace(substr({s}, f + 1, i - f), 'N', ''))) / i ELSE -1.0 END)"""
    cut = lambda s, p, f: f"CASE WHEN {f} = length({s}) THEN length({s}) WHEN list_max({p}) >= {share} THEN length({s}) + 1 - list_position(list_reverse({p}), list_max({p})) ELSE {f} END"
    sql = f"""SELECT ord, CASE WHEN g = length(t) THEN '' WHEN c2 = length(t) THEN t ELSE left(t, length(t) - c2) END AS seq FROM (
      SELECT ord, t, g, {cut('t', 'p2', 'g')} AS c2 FROM (
        SELECT ord, t, f AS g, {part('reverse(t)')} AS p2 FROM (
          SELECT ord, t, length(t) - length(rtrim(t, 'N')) AS f FROM (
            SELECT ord, substr(s, {cut('s', 'p', 'f')} + 1) AS t FROM (
              SELECT ord, s, f, {part('s')} AS p FROM (SELECT ord, s, length(s) - length(ltrim(s, 'N')) AS f FROM n_reads))))))"""

    # every seventh read begins and every ninth ends with Ns, as the derived reads seldom do
    with_n = "n_reads AS (SELECT ord, concat(repeat('N', CASE WHEN ord % 7 = 0 THEN CAST(ord % 5 AS INT) ELSE 0 END), m_f_seq, repeat('N', CASE WHEN ord % 9 = 0 THEN CAST(ord % 4 AS INT) ELSE 0 END)) AS s FROM reads)"

    @query(name, sql, with_n)
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = reads(spark, d, "m_f_seq").select("ord", F.expr("concat(repeat('N', case when ord % 7 = 0 then cast(ord % 5 as int) else 0 end), m_f_seq, repeat('N', case when ord % 9 = 0 then cast(ord % 4 as int) else 0 end))").alias("s"))
        return trimming.n_trim(made.withColumn("q", F.col("s")), "s", "q", share).select("ord", F.col("s").alias("seq"))


n_trim_query("n_trim_half", 0.5)
n_trim_query("n_trim_tenth", 0.1)


# --- matching ---------------------------------------------------------------------------------------------------------


def ends_sql(pattern: str, seq: str = "f_seq", overlap: int | None = None, wildcard: bool = False, source: str = "reads", carry: str = "ord") -> str:
    """Rows (end, edits, length) of substitutions alone: the last L bases of the pattern at each end."""
    m = len(pattern)
    least = m if overlap is None else min(overlap, m)
    a, b = f"substr({seq}, CAST(e - least(e, {m}) + 1 AS INT), CAST(least(e, {m}) AS INT))", f"right('{pattern}', CAST(least(e, {m}) AS INT))"
    edits = f"len(list_filter(list_zip(string_split({a}, ''), string_split({b}, '')), lambda p: p[1] <> p[2] AND p[1] <> 'N' AND p[2] <> 'N'))" if wildcard else f"hamming({a}, {b})"
    return f"SELECT {carry}, CAST(e - 1 AS INT) AS \"end\", CAST({edits} AS INT) AS edits, CAST(least(e, {m}) AS INT) AS length FROM {source}, unnest(range({least}, length({seq}) + 1)) AS x(e)"


def search_query(name: str, pattern: str, how: Search, condition: str, overlap: int | None = None, best_only: bool = False) -> None:
    found = ends_sql(pattern, overlap=overlap, wildcard=how.wildcard)
    sql = f'SELECT ord, "end", edits, length FROM ({found}) WHERE {condition}'
    if best_only:
        sql = f'SELECT ord, "end", edits, length FROM (SELECT *, min(edits) OVER (PARTITION BY ord) AS least_edits FROM ({sql})) WHERE edits = least_edits'

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = matching.find_matches(reads(spark, d, "f_seq"), "f_seq", pattern, how, best_only=best_only)
        return found.select("ord", F.explode("matches").alias("m")).select("ord", "m.end", "m.edits", "m.length")


search_query("hamming_search_full", ADAPTER, Search(Budget(2)), "edits <= 2")
search_query("hamming_search_partial", ADAPTER, Search(Budget(1), overlap=5), "edits <= 1", 5)
search_query("hamming_search_fraction", ADAPTER, Search(Budget.of(0.2), overlap=4), "edits <= 0.2 * length", 4)
search_query("hamming_search_wildcard", "AGANCGG", Search(Budget(1), wildcard=True), "edits <= 1")
search_query("hamming_search_best_only", "TGCAG", Search(Budget(2)), "edits <= 2", best_only=True)


def edit_ends_sql(pattern: str, budget: int, seq: str = "f_seq", overlap: int | None = None, source: str = "reads") -> str:
    """Rows (end, edits, length) with indels: every start that could stay in the budget, and every overhang over the left edge."""
    m = len(pattern)
    least = m if overlap is None else min(overlap, m)
    inside = f"SELECT ord, e, levenshtein('{pattern}', substr({seq}, CAST(e - l + 1 AS INT), CAST(l AS INT))) AS x FROM {source}, unnest(range(1, length({seq}) + 1)) AS a(e), unnest(range({max(0, m - budget)}, {m + budget + 1})) AS b(l) WHERE l <= e"
    over = f"SELECT ord, e, levenshtein(substr('{pattern}', CAST(k + 1 AS INT)), left({seq}, CAST(e AS INT))) AS x FROM {source}, unnest(range(1, {m - 1 + budget + 1})) AS a(e), unnest(range(1, {m - least + 1})) AS b(k) WHERE e <= length({seq})"
    both = f"{inside} UNION ALL {over}" if least < m else inside
    return f"SELECT ord, CAST(e - 1 AS INT) AS \"end\", CAST(min(x) AS INT) AS edits, CAST(least(e, {m}) AS INT) AS length FROM ({both}) WHERE e >= {least} GROUP BY ord, e HAVING min(x) <= {budget}"


def edit_query(name: str, pattern: str, budget: int, overlap: int | None = None) -> None:
    @query(name, edit_ends_sql(pattern, budget, overlap=overlap))
    def run(spark: SparkSession, d: str) -> DataFrame:
        how = Search(Budget(budget), indels=True, overlap=FULL if overlap is None else overlap)
        found = matching.find_matches(reads(spark, d, "f_seq"), "f_seq", pattern, how)
        return found.select("ord", F.explode("matches").alias("m")).select("ord", "m.end", "m.edits", "m.length")


edit_query("edit_search_full", "TGCAG", 1)
edit_query("edit_search_partial", ADAPTER, 1, 6)


def likeliest_sql(pattern: str, prior: float) -> str:
    m = len(pattern)
    at = "CAST(e - {m} + i AS INT)".format(m=m)
    same = f"substr(f_seq, {at}, 1) = substr('{pattern}', CAST(i AS INT), 1)"
    err = f"pow(10.0, -(ascii(substr(f_qual, {at}, 1)) - 33) / 10.0)"
    a = f"list_product(list_transform(range(1, {m + 1}), lambda i: CASE WHEN {same} THEN 1 - {err} ELSE {err} END))"
    b = f"list_product(list_transform(range(1, {m + 1}), lambda i: CASE WHEN {same} THEN 0.25 ELSE 0.75 END))"
    return f"""SELECT ord, CAST(e - 1 AS INT) AS "end" FROM (
      SELECT ord, e, row_number() OVER (PARTITION BY ord ORDER BY round(a / (a + b), 12) DESC, e) AS n FROM (
        SELECT ord, e, {a} * {prior} AS a, {b} * {1 - prior} AS b FROM reads, unnest(range({m}, length(f_seq) + 1)) AS x(e)) WHERE a > b) WHERE n = 1"""


@query("likeliest_search", likeliest_sql("TGCAG", 0.5))
def likeliest_search(spark: SparkSession, d: str) -> DataFrame:
    found = matching.find_likeliest(reads(spark, d, "f_seq", "f_qual"), "f_seq", "f_qual", "TGCAG", 0.5)
    return found.where("end is not null").select("ord", "end")


# --- adapters ---------------------------------------------------------------------------------------------------------


def adapter_query(name: str, adapters: list[Adapter], how: Search, offset: int = 1000, required: bool = False) -> None:
    parts = []
    for i, a in enumerate(adapters):
        seq, pattern = ("f_seq", a.seq) if a.start else ("reverse(f_seq)", a.seq[::-1])
        size = (0 if a.anchored else offset) + len(a.seq) + how.slack(len(a.seq))
        source = f"(SELECT ord, left({seq}, {size}) AS t FROM reads)"
        overlap = None if a.anchored else how.overlap
        found = edit_ends_sql(pattern, how.budget.edits, "t", overlap, source) if how.indels else f"SELECT * FROM ({ends_sql(pattern, 't', overlap, source=source)}) WHERE edits <= {how.budget.edits}"
        order = 'edits, "end" DESC' if a.anchored else 'length DESC, edits, "end"'
        parts.append(f'SELECT ord, "end", edits, length, {i} AS a, {str(a.start).lower()} AS five FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY {order}) AS n FROM ({found})) WHERE n = 1')
    best = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY length DESC, edits, a) AS n FROM ({' UNION ALL '.join(parts)})) WHERE n = 1"
    sql = f"""SELECT r.ord, CASE WHEN b.ord IS NULL THEN f_seq WHEN five THEN substr(f_seq, "end" + 2) ELSE left(f_seq, length(f_seq) - 1 - "end") END AS seq
      FROM reads r {'' if required else 'LEFT'} JOIN ({best}) b ON b.ord = r.ord"""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        cut = trimming.adapter_trim(reads(spark, d, "f_seq", "f_qual"), "f_seq", "f_qual", adapters, how, offset, flag="cut")
        return (cut.where("cut") if required else cut).select("ord", F.col("f_seq").alias("seq"))


adapter_query("adapter_3p", [Adapter.three(ADAPTER)], Search(Budget(1), overlap=3))
adapter_query("adapter_3p_indels", [Adapter.three(ADAPTER)], Search(Budget(1), indels=True, overlap=3))
adapter_query("adapter_5p", [Adapter.five("TGCAG")], Search(Budget(1), overlap=3), offset=8)
adapter_query("adapter_anchored_5p", [Adapter.five("^ACGTACTGC")], Search(Budget(2)))
adapter_query("adapter_anchored_3p", [Adapter.three("GGAAGAGTTTT$")], Search(Budget(1)))
adapter_query("adapter_multi", [Adapter.three(ADAPTER), Adapter.five("^ACGTAC"), Adapter.three("GAAGAGTTTT$")], Search(Budget(1), overlap=4))
adapter_query("adapter_required", [Adapter.three(ADAPTER)], Search(Budget(0), overlap=6), required=True)


# --- pairs ------------------------------------------------------------------------------------------------------------


@query("pair_join", "SELECT ord, f_seq, r_seq FROM reads WHERE length(f_seq) > 55")
def pair_join(spark: SparkSession, d: str) -> DataFrame:
    f, r = reads(spark, d, "f_seq"), reads(spark, d, "r_seq")
    return f.where(F.length("f_seq") > 55).join(r, "ord").select("ord", "f_seq", "r_seq")


def merge_sql(budget: int, overlap: int, required: bool) -> str:
    """The best overlap of the turned reverse read, then the merged bases place by place."""
    hits = f"""SELECT ord, s1, q1, s2, q2, 40 - e AS start FROM (
      SELECT *, row_number() OVER (PARTITION BY ord ORDER BY least(e, 40) DESC, x, e) AS n FROM (
        SELECT ord, s1, q1, s2, q2, e, hamming(right(s1, CAST(least(e, 40) AS INT)), substr(s2, CAST(e - least(e, 40) + 1 AS INT), CAST(least(e, 40) AS INT))) AS x
        FROM t, unnest(range({overlap}, 41)) AS y(e)) WHERE x <= {budget}) WHERE n = 1"""
    place = """CASE WHEN i < start THEN substr(s1, CAST(i + 1 AS INT), 1) WHEN i >= 40 THEN substr(s2, CAST(i - start + 1 AS INT), 1)
      WHEN substr(s1, CAST(i + 1 AS INT), 1) = substr(s2, CAST(i - start + 1 AS INT), 1) OR ascii(substr(q1, CAST(i + 1 AS INT), 1)) > ascii(substr(q2, CAST(i - start + 1 AS INT), 1))
      THEN substr(s1, CAST(i + 1 AS INT), 1) ELSE substr(s2, CAST(i - start + 1 AS INT), 1) END"""
    merged = f"SELECT ord, string_agg({place}, '' ORDER BY i) AS seq FROM hits, unnest(range(0, 40 + start)) AS z(i) GROUP BY ord"
    return f"""SELECT t.ord, coalesce(m.seq, s1 || s2) AS seq, m.seq IS NOT NULL AND length(m.seq) <> 80 AS merged
      FROM t {'' if required else 'LEFT'} JOIN ({merged}) m ON m.ord = t.ord""".replace("FROM hits", f"FROM ({hits}) h")


_TURNED = "t AS (SELECT ord, m_f_seq AS s1, m_f_qual AS q1, reverse(translate(r_seq, 'ACGT', 'TGCA')) AS s2, reverse(r_qual) AS q2 FROM reads)"


def merge_query(name: str, required: bool) -> None:
    @query(name, merge_sql(1, 8, required), _TURNED)
    def run(spark: SparkSession, d: str) -> DataFrame:
        pairs = reads(spark, d, "m_f_seq", "m_f_qual", "r_seq", "r_qual")
        done = merging.merge_pairs(pairs, "m_f_seq", "m_f_qual", how=Search(Budget(1), overlap=8)).select("ord", "seq", "merged")
        return done.where("merged") if required else done


merge_query("merge_pairs", False)
merge_query("merge_required", True)


# --- samples ----------------------------------------------------------------------------------------------------------


@query(
    "enzyme_lookup",
    "SELECT s.name, barcode, seq FROM (VALUES ('S0','ACGTAC','PSTI'),('S1','TTGCCA','APEKI'),('S2','GGATCT','MYZYME'),('S3','CATGAG','PSTI')) s(name, barcode, enzyme) JOIN (VALUES ('PSTI','TGCAG'),('PSTI','TGGAG'),('APEKI','CAGC'),('APEKI','CTGC'),('MYZYME','AATT')) e(enzyme, seq) ON s.enzyme = e.enzyme",
)
def enzyme_lookup(spark: SparkSession, d: str) -> DataFrame:
    known = enzymes.enzymes(spark, [("PSTI", "TGGAG"), ("myzyme", "aatt")])
    sheet = spark.createDataFrame([("S0", "ACGTAC", "PSTI"), ("S1", "TTGCCA", "APEKI"), ("S2", "GGATCT", "MYZYME"), ("S3", "CATGAG", "PSTI")], "name string, barcode string, enzyme string").selectExpr("*", "enzyme as r_enzyme", "cast(null as string) as r_barcode")
    return enzymes.with_remnants(sheet, known).select("name", "barcode", F.explode("remnants").alias("seq"))


_SHEET_SQL = "sheet(i, name, barcode) AS (VALUES " + ", ".join(f"({i}, '{n}', '{b}')" for i, (n, b) in enumerate(SHEET.items())) + ")"


def samples(enzyme: bool = True) -> tuple[demux.Sample, ...]:
    return tuple(demux.Sample(n, b, (REMNANT,) if enzyme else ("",)) for n, b in SHEET.items())


def barcode_sql(seq: str, offset: int, enzyme: bool, budget: int, source: str = "reads") -> str:
    """Every (read, sample) with the barcode's best place, and where the remnant behind it ends."""
    hit = lambda e: f"hamming(substr({seq}, CAST({e} - 5 AS INT), 6), barcode)"
    bars = f"SELECT ord, {seq}, i, name, e, {hit('e')} AS edits FROM {source}, sheet, unnest(range(6, {6 + offset} + 1)) AS x(e) WHERE e <= length({seq}) AND {hit('e')} <= {budget}"
    if not enzyme:
        return f"SELECT ord, i, name, e AS barcode_end, e AS enzyme_end, edits, row_number() OVER (PARTITION BY ord, i ORDER BY edits, e) AS n FROM ({bars})"
    tail = f"hamming(substr({seq}, CAST(g - 4 AS INT), 5), '{REMNANT}')"
    tails = f"SELECT b.*, g, {tail} AS z FROM ({bars}) b, unnest(range(e + 5, e + 5 + {offset} + 1)) AS y(g) WHERE g <= length({seq}) AND {tail} <= {budget}"
    first = f"SELECT *, row_number() OVER (PARTITION BY ord, i, e ORDER BY z, g) AS k FROM ({tails})"
    return f"SELECT ord, i, name, e AS barcode_end, g AS enzyme_end, edits, row_number() OVER (PARTITION BY ord, i ORDER BY edits, e) AS n FROM ({first}) WHERE k = 1"


def sample_sql(seq: str, offset: int, enzyme: bool, budget: int, single: bool = False, source: str = "reads") -> str:
    """The sample of each read that has one."""
    each = f"SELECT * FROM ({barcode_sql(seq, offset, enzyme, budget, source)}) WHERE n = 1"
    return f"SELECT ord, name AS sample, CAST(barcode_end AS INT) AS barcode_end, CAST(enzyme_end AS INT) AS enzyme_end, CAST(edits AS INT) AS edits FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY edits, i) AS best, count(*) OVER (PARTITION BY ord) AS many FROM ({each})) WHERE best = 1{' AND many = 1' if single else ''}"


def demux_query(name: str, spec: demux.Demux, enzyme: bool, offset: int, single: bool = False) -> None:
    sql = f"SELECT r.ord, sample, barcode_end, enzyme_end, edits FROM reads r LEFT JOIN ({sample_sql('f_seq', offset, enzyme, spec.how.budget.edits, single)}) s ON s.ord = r.ord"

    @query(name, sql, _SHEET_SQL)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return demux.demux(reads(spark, d, "f_seq", "f_qual"), spec).select("ord", "sample", "barcode_end", "enzyme_end", "edits")


ONE = Search(Budget(1))
demux_query("demux_barcode", demux.Demux(samples(False), ONE), False, 0)
demux_query("demux_with_enzyme", demux.Demux(samples(), ONE), True, 0)
demux_query("demux_with_offset", demux.Demux(samples(), ONE, offset=2), True, 2)
demux_query("demux_single_only", demux.Demux(samples(False), Search(Budget(4)), single_only=True), False, 0, True)


def indel_sql(pattern: str, budget: int, seq: str, e: str, least: str) -> str:
    """The edits of the best alignment of a pattern that ends at base e and starts at base `least` or later."""
    return f"list_min(list_transform(range(0, length({pattern}) + {budget} + 1), lambda l: CASE WHEN {e} - l + 1 < {least} THEN 99 ELSE levenshtein({pattern}, substr({seq}, CAST({e} - l + 1 AS INT), CAST(l AS INT))) END))"


@query(
    "demux_indels",
    f"""SELECT r.ord, sample, CAST(barcode_end AS INT) AS barcode_end, CAST(enzyme_end AS INT) AS enzyme_end, CAST(edits AS INT) AS edits FROM reads r LEFT JOIN (
      SELECT ord, name AS sample, e AS barcode_end, g AS enzyme_end, edits, row_number() OVER (PARTITION BY ord ORDER BY edits, i, e) AS best FROM (
        SELECT *, row_number() OVER (PARTITION BY ord, i, e ORDER BY z, g) AS k FROM (
          SELECT *, {indel_sql("'" + REMNANT + "'", 1, "f_seq", "g", "e + 1")} AS z FROM (
            SELECT ord, f_seq, i, name, e, edits, g FROM (
              SELECT ord, f_seq, i, name, e, {indel_sql("barcode", 1, "f_seq", "e", "1")} AS edits FROM reads, sheet, unnest(range(6, 8)) AS x(e)) b, unnest(range(e + 1, e + 7)) AS y(g)
            WHERE edits <= 1 AND g <= length(f_seq)))
        WHERE z <= 1) WHERE k = 1) s ON s.ord = r.ord AND best = 1""",
    _SHEET_SQL,
)
def demux_indels(spark: SparkSession, d: str) -> DataFrame:
    return demux.demux(reads(spark, d, "f_seq", "f_qual"), demux.Demux(samples(), Search(Budget(1), indels=True))).select("ord", "sample", "barcode_end", "enzyme_end", "edits")


@query(
    "demux_index_read",
    f"SELECT r.ord, sample, barcode_end FROM reads r LEFT JOIN ({sample_sql('i1_seq', 0, False, 1)}) s ON s.ord = r.ord",
    _SHEET_SQL,
)
def demux_index_read(spark: SparkSession, d: str) -> DataFrame:
    return demux.demux_by_index(reads(spark, d, "i1_seq"), demux.Demux(samples(False), ONE)).select("ord", "sample", "barcode_end")


# a reverse read that carries the complement of its barcode and remnant for two of every three reads
_MATES = "mates AS (SELECT *, CASE WHEN ord % 3 = 0 THEN r_seq ELSE concat(translate(substr(f_seq, 1, 6), 'ACGT', 'TGCA'), 'TGCAG', r_seq) END AS mate FROM reads)"


@query(
    "demux_reverse_check",
    f"""SELECT ord, sample FROM (
      SELECT f.ord, f.name AS sample, row_number() OVER (PARTITION BY f.ord ORDER BY f.edits, f.i) AS best
      FROM (SELECT * FROM ({barcode_sql('f_seq', 0, True, 1, 'mates')}) WHERE n = 1) f
      JOIN (SELECT DISTINCT ord, i FROM ({barcode_sql('mate', 0, True, 1, 'mates').replace('sheet', 'turned')})) r ON r.ord = f.ord AND r.i = f.i) WHERE best = 1""",
    f"{_SHEET_SQL}, turned AS (SELECT i, name, translate(barcode, 'ACGT', 'TGCA') AS barcode FROM sheet), {_MATES}",
)
def demux_reverse_check(spark: SparkSession, d: str) -> DataFrame:
    mate = F.when(F.col("ord") % 3 == 0, F.col("r_seq")).otherwise(F.concat(S.complement(F.substring("f_seq", 1, 6)), F.lit(REMNANT), "r_seq"))
    pairs = reads(spark, d, "f_seq", "f_qual", "r_seq").withColumn("mate", mate).withColumn("mate_q", F.repeat(F.lit("I"), F.length("mate")))
    found = demux.demux(pairs, demux.Demux(samples(), ONE, check_reverse=True), r_seq="mate", r_qual="mate_q")
    return found.where("sample is not null").select("ord", "sample")


_FOUND = f"found AS ({sample_sql('f_seq', 0, True, 1)})"


@query(
    "demux_trim",
    "SELECT r.ord, sample, substr(f_seq, enzyme_end + 1) AS without_both, left(f_seq, barcode_end) || substr(f_seq, enzyme_end + 1) AS without_enzyme, substr(f_seq, barcode_end + 1) AS without_barcode FROM reads r JOIN found ON found.ord = r.ord",
    f"{_SHEET_SQL}, {_FOUND}",
)
def demux_trim(spark: SparkSession, d: str) -> DataFrame:
    found = demux.demux(reads(spark, d, "f_seq", "f_qual"), demux.Demux(samples(), ONE)).where("sample is not null")
    cut = lambda b, e: trimming.barcode_trim(F.col("f_seq"), F.col("barcode_end"), F.col("enzyme_end"), b, e)
    return found.select("ord", "sample", cut(True, True).alias("without_both"), cut(False, True).alias("without_enzyme"), cut(True, False).alias("without_barcode"))


@query("undetermined_reads", "SELECT ord, f_seq FROM reads WHERE ord NOT IN (SELECT ord FROM found)", f"{_SHEET_SQL}, {_FOUND}")
def undetermined_reads(spark: SparkSession, d: str) -> DataFrame:
    return process(reads(spark, d, "f_seq", "f_qual"), Config(demux=demux.Demux(samples(), ONE), trim_barcode=True)).where("not kept").select("ord", "f_seq")


# --- deduplication ----------------------------------------------------------------------------------------------------

_UMI = "u AS (SELECT *, right(i1_seq, 12) AS umi, ord % 4 AS lot FROM reads)"


@query("dedup_first", "SELECT ord, umi FROM (SELECT *, row_number() OVER (PARTITION BY lot, umi ORDER BY ord) AS n FROM u) WHERE n = 1", _UMI)
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_read(reads(spark, d, "i1_seq").withColumn("lot", F.col("ord") % 4), "i1_seq", by=["lot"]).select("ord", "umi")


_ERRORS = f"list_sum(list_transform({phred('f_qual')}, lambda x: pow(10.0, -x / 10.0)))"


@query("dedup_best", f"SELECT ord, umi, round(e, 6) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY lot, umi ORDER BY e, ord) AS n FROM (SELECT *, {_ERRORS} AS e FROM u)) WHERE n = 1", _UMI)
def dedup_best(spark: SparkSession, d: str) -> DataFrame:
    best = dedup.best_read(reads(spark, d, "i1_seq", "f_qual").withColumn("lot", F.col("ord") % 4), "i1_seq", ["f_qual"], by=["lot"])
    return best.select("ord", "umi", F.round("errors", 6).alias("errors"))


@query("duplicates", "SELECT ord, umi FROM (SELECT *, row_number() OVER (PARTITION BY umi ORDER BY ord) AS n FROM u) WHERE n > 1", _UMI)
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.mark_duplicates(reads(spark, d, "i1_seq"), S.umi("i1_seq", 12), [], [F.col("ord")]).where("duplicate").select("ord", "umi")


@query("dedup_counts", "SELECT CAST(lot AS INT) AS lot, count(*) AS n, count(*) - count(DISTINCT umi) AS removed FROM u GROUP BY lot", _UMI)
def dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    marked = dedup.mark_duplicates(reads(spark, d, "i1_seq").withColumn("lot", (F.col("ord") % 4).cast("int")), S.umi("i1_seq", 12), ["lot"], [F.col("ord")])
    return marked.groupBy("lot").agg(F.count("*").alias("n"), F.sum(F.col("duplicate").cast("long")).alias("removed"))


# --- statistics and the whole run -------------------------------------------------------------------------------------

RUN = Config(demux=demux.Demux(samples(), ONE), quality=20, trim_barcode=True, trim_enzyme=True, adapters=(Adapter.three(ADAPTER),), adapter_search=Search(Budget(1), overlap=3), adapter_offset=1000, least_length=30)

_RUN_SQL = f"""{_SHEET_SQL}, {_FOUND},
cut_reads AS (
  SELECT r.ord, sample, f_seq AS raw, CASE WHEN sample IS NOT NULL AND list_sum({phred('f_qual')}) / length(f_qual) >= 20 THEN substr(f_seq, enzyme_end + 1) END AS s
  FROM reads r LEFT JOIN found ON found.ord = r.ord),
cuts AS (
  SELECT ord, "end" FROM (
    SELECT *, row_number() OVER (PARTITION BY ord ORDER BY length DESC, edits, "end") AS n
    FROM ({ends_sql(ADAPTER[::-1], 't', 3, source="(SELECT ord, reverse(s) AS t FROM cut_reads WHERE s IS NOT NULL)")}) WHERE edits <= 1) WHERE n = 1),
done AS (
  SELECT c.ord, sample, raw, CASE WHEN k.ord IS NULL THEN s ELSE left(s, length(s) - 1 - "end") END AS s, k.ord IS NOT NULL AS cut
  FROM cut_reads c LEFT JOIN cuts k ON k.ord = c.ord),
ran AS (
  SELECT ord, CASE WHEN length(s) >= 30 THEN sample ELSE 'Undetermined' END AS sample, CASE WHEN length(s) >= 30 THEN s ELSE raw END AS seq,
         CASE WHEN length(s) >= 30 AND cut THEN 1 ELSE 0 END AS adapters
  FROM done)"""


def run_all(spark: SparkSession, d: str) -> DataFrame:
    return process(reads(spark, d, "f_seq", "f_qual"), RUN)


@query("full_run", "SELECT ord, sample, seq, adapters FROM ran", _RUN_SQL)
def full_run(spark: SparkSession, d: str) -> DataFrame:
    return run_all(spark, d).select("ord", "sample", F.col("f_seq").alias("seq"), F.col("n_adapters").alias("adapters"))


_COUNTS = "SELECT sample, count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum(adapters) AS BIGINT) AS adapters FROM ran GROUP BY sample"


@query("stats_by_sample", _COUNTS, _RUN_SQL)
def stats_by_sample(spark: SparkSession, d: str) -> DataFrame:
    return stats.counts(run_all(spark, d)).select("sample", "reads", "bases", "adapters")


@query("stats_total", f"SELECT CASE WHEN grouping(sample) = 1 THEN 'Total' ELSE sample END AS sample, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(bases) AS BIGINT) AS bases, CAST(sum(adapters) AS BIGINT) AS adapters FROM ({_COUNTS}) GROUP BY ROLLUP (sample)", _RUN_SQL)
def stats_total(spark: SparkSession, d: str) -> DataFrame:
    return stats.with_total(stats.counts(run_all(spark, d))).select("sample", "reads", "bases", "adapters")


@query(
    "stats_shares",
    f"""SELECT sample, round(reads / (SELECT count(*) FROM ran), 9) AS share_reads, round(adapters / reads, 9) AS share_adapters, round(bases / (SELECT sum(length(seq)) FROM ran), 9) AS share_bases
    FROM ({_COUNTS} UNION ALL SELECT 'Total', count(*), CAST(sum(length(seq)) AS BIGINT), CAST(sum(adapters) AS BIGINT) FROM ran)""",
    _RUN_SQL,
)
def stats_shares(spark: SparkSession, d: str) -> DataFrame:
    return statistics(run_all(spark, d)).select("sample", *[F.round(c, 9).alias(c) for c in ("share_reads", "share_adapters", "share_bases")])
