"""Sources, sinks, plans and edge rows."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from seqloom.functions import scalars as S
from seqloom.operators import dedup, demux, stats
from seqloom.operators.kernels import Adapter, Budget, Search
from seqloom.plans.config import Config
from seqloom.plans.process import process, statistics
from seqloom.plans.simulate import random_edits, random_quality, simulate_pairs, simulate_reads
from seqloom.sources import enzymes, fastq

ONE = Search(Budget(1))


def reads(spark, rows, schema="ord long, f_seq string, f_qual string"):
    return spark.createDataFrame(rows, schema)


def test_fastq_source_reads_plain_gzip_and_ragged_files(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r0\nACGT\nanything\nIIII\n@r1\n\n+\n\n@r2\nAC\n+\nII\n@cut\nAC")
    with gzip.open(tmp_path / "b.FASTQ.GZ", "wt") as f:
        f.write("@x\nTT\n+\nII")
    got = fastq.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(0, "@r0", "ACGT", "IIII"), (1, "@r1", "", ""), (2, "@r2", "AC", "II")]
    assert fastq.read_fastq(spark, str(tmp_path / "b.FASTQ.GZ")).first()["seq"] == "TT"
    records = [(i, f"@r{i}", "ACGTN"[: 1 + i % 5], "@IIII"[: 1 + i % 5]) for i in range(500)]
    (tmp_path / "big.fastq").write_text("".join(f"{h}\r\n{s}\r\n+\r\n{q}\r\n" for _, h, s, q in records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        split = fastq.read_fastq_text(spark, str(tmp_path / "*.fastq")).where("file like '%big%'").orderBy("ord").drop("file")
        assert [tuple(r) for r in split.collect()] == records
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = fastq.read_fastq_text(spark, str(tmp_path / "a.fastq")).orderBy("ord").drop("file").collect()
    assert [tuple(r) for r in text] == [tuple(r) for r in got]


def test_strict_source_rejects(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("r0\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="isn't a valid FASTQ record"):
        fastq.read_fastq(spark, str(tmp_path / "a.fastq"), strict=True).collect()


def test_files_join_by_position_up_to_the_shortest(spark):
    f = spark.createDataFrame([(0, "@a", "AC", "II"), (1, "@b", "GT", "II")], fastq.SCHEMA)
    r = spark.createDataFrame([(0, "@other", "TT", "II")], fastq.SCHEMA)
    got = fastq.join_files(f, r).collect()
    assert len(got) == 1 and got[0]["r_header"] == "@other"


def test_sink_makes_folders_for_samples_that_occur(spark, tmp_path):
    df = spark.createDataFrame([("S0", 1, "@b", "GT", "II"), ("S0", 0, "@a", "AC", "II"), ("S1", 2, "@c", "T", "I")], "sample string, ord long, header string, seq string, qual string")
    fastq.write_fastq(df, str(tmp_path / "out"), ["sample"])
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert names == ["sample=S0", "sample=S1"]
    text = "".join(p.read_text() for p in (tmp_path / "out" / "sample=S0").glob("part*"))
    assert text == "@a\nAC\n+\nII\n@b\nGT\n+\nII\n"


def test_sample_sheet_and_enzymes(spark, tmp_path):
    (tmp_path / "sheet").write_text("A acgt PstI\nB\tTTTT ApeKI MspI GGGG\n")
    sheet = fastq.read_sample_sheet(spark, str(tmp_path / "sheet"))
    got = {r["name"]: r for r in enzymes.with_remnants(sheet, enzymes.enzymes(spark)).collect()}
    assert got["A"]["barcode"] == "ACGT" and got["A"]["r_remnants"] == ["TGCAG"] and got["A"]["r_barcode"] is None
    assert got["B"]["remnants"] == ["CAGC", "CTGC"] and got["B"]["r_remnants"] == ["CGG"] and got["B"]["r_barcode"] == "GGGG"
    (tmp_path / "bad").write_text("A ACGT NOSUCH\n")
    with pytest.raises(Exception, match="unknown enzyme"):
        enzymes.with_remnants(fastq.read_sample_sheet(spark, str(tmp_path / "bad")), enzymes.enzymes(spark)).collect()


def test_filters_keep_one_of_five(spark):
    rows = [(0, "ACGTACGTACGTACGTACGTACGT", "I" * 24), (1, "ACGT", "IIII"), (2, "N" * 12 + "A" * 12, "I" * 24), (3, "A" * 24, "!" * 24), (4, "A" * 40, "I" * 40), (5, "", ""), (6, None, None)]
    done = process(reads(spark, rows), Config(most_n=0.25, quality=20, least_length=10, most_length=30))
    assert [r["ord"] for r in done.where("kept").collect()] == [0]
    assert done.count() == 7


def test_letters_outside_dna_are_undetermined_or_an_error(spark):
    rows = [(0, "ACXT", "IIII"), (1, "acgtn", "IIIII")]
    assert [r["ord"] for r in process(reads(spark, rows), Config()).where("kept").collect()] == [1]
    with pytest.raises(Exception, match="a base outside ACGTN"):
        process(reads(spark, rows), Config(strict=True)).collect()


def test_empty_table(spark):
    assert process(reads(spark, []), Config(adapters=(Adapter.three("ACGT"),), trim_n=0.5, quality_three=10)).count() == 0


def test_undetermined_reads_stay_as_they_came(spark):
    d = demux.Demux((demux.Sample("A", "ACGTAC", ("TGCAG",)),), ONE)
    rows = [(0, "ACGTACTGCAGTTTTNN", "I" * 17), (1, "GGGGGGTGCAGTTTTNN", "I" * 17)]
    got = {r["ord"]: r for r in process(reads(spark, rows), Config(demux=d, trim_barcode=True, trim_enzyme=True, trim_n=0.5)).collect()}
    assert (got[0]["sample"], got[0]["f_seq"]) == ("A", "TTTT")
    assert (got[1]["sample"], got[1]["f_seq"]) == ("Undetermined", "GGGGGGTGCAGTTTTNN")


def test_enzyme_alone_is_cut_from_the_middle(spark):
    d = demux.Demux((demux.Sample("A", "ACGTAC", ("TGCAG",)),), ONE)
    got = process(reads(spark, [(0, "ACGTACTGCAGTTTT", "ABCDEFGHIJKLMNO")]), Config(demux=d, trim_enzyme=True)).first()
    assert (got["f_seq"], got["f_qual"]) == ("ACGTACTTTT", "ABCDEFLMNO")


def test_sheet_with_equal_barcodes_is_refused():
    with pytest.raises(ValueError, match="must differ"):
        demux.Demux((demux.Sample("A", "AC"), demux.Sample("B", "AC")))


def test_single_only_leaves_ambiguous_reads(spark):
    two = (demux.Sample("A", "AAAAAA"), demux.Sample("B", "AAAAAC"))
    rows = [(0, "AAAAAAGG", "I" * 8), (1, "GGGGGGGG", "I" * 8)]
    pick = lambda single: {r["ord"]: r["sample"] for r in demux.demux(reads(spark, rows), demux.Demux(two, ONE, single_only=single)).collect()}
    assert pick(False) == {0: "A", 1: None} and pick(True) == {0: None, 1: None}


def test_demux_with_indels_against_alignment(spark):
    from tests.test_kernels import levenshtein

    d = demux.Demux((demux.Sample("A", "ACGTAC", ("TGCAG",)), demux.Sample("B", "TTGCCA", ("TGCAG",))), Search(Budget(1), indels=True))
    seqs = ["ACGTACTGCAGTT", "ACGACTGCAGTTT", "ACGTTACTGCAGT", "TTGCCATGCGTTT", "TTGACATGCAGTT", "GGGGGGGGGGGGG", "ACGTACTTTTTTT"]
    got = [r["sample"] for r in demux.demux(reads(spark, [(i, s, "I" * len(s)) for i, s in enumerate(seqs)]), d).orderBy("ord").collect()]
    want = []
    for s in seqs:
        best = None
        for k in d.samples:
            for e in range(5, 7):
                edits = min(levenshtein(k.barcode, s[a : e + 1]) for a in range(e + 2))
                behind = any(levenshtein("TGCAG", s[a:b]) <= 1 for a in range(e + 1, len(s)) for b in range(a, min(e + 8, len(s) + 1)) if b > e + 1)
                if edits <= 1 and behind and (best is None or edits < best[0]):
                    best = (edits, k.name)
        want.append(best[1] if best else None)
    assert got == want


def test_umi_of_short_index_reads(spark):
    df = spark.createDataFrame([(0, "AC"), (1, "GGacgtAC"), (2, "TTACGTAC"), (3, None)], "ord long, i1_seq string")
    kept = dedup.first_read(df, "i1_seq", size=6).collect()
    assert [(r["ord"], r["umi"]) for r in kept] == [(1, "ACGTAC")]
    marked = {r["ord"]: r["duplicate"] for r in dedup.mark_duplicates(df, S.umi("i1_seq", 6), [], [F.col("ord")]).collect()}
    assert marked == {0: None, 1: False, 2: True, 3: None}


def test_dedup_parts_add_up(spark):
    rows = [(i, "ACGT", "IIII" if i % 2 else "5555", "AAAAAACCCCCC"[: 12 - i % 3]) for i in range(20)]
    df = spark.createDataFrame(rows, "ord long, f_seq string, f_qual string, i1_seq string")
    for how in ("first", "best"):
        done = process(df, Config(dedup=how, umi=10)).collect()
        kept = [r for r in done if r["duplicate"] is False]
        assert len(kept) == len({r["i1_seq"][-10:] for r in done})
        if how == "best":
            assert all(r["f_qual"] == "IIII" for r in kept)
    with pytest.raises(ValueError, match="needs index reads"):
        process(df.drop("i1_seq"), Config(dedup="first"))


def test_report_lines(spark):
    rows = [("Kept", 12, 133, 0, 7, 0, 0), ("Undetermined", 4, 101, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "sample string, reads long, bases long, merged long, adapters long, trimmed long, duplicates long")
    lines = [r["line"] for r in stats.report(stats.shares(stats.with_total(df))).orderBy("n").collect()]
    assert lines[0].startswith("File".ljust(25) + " " + "Forwards Barcodes".ljust(25)) and len(lines) == 4
    cells = [lines[1][i : i + 25].strip() for i in range(0, len(lines[1]), 26)]
    assert cells == ["Kept", "", "12", "0.75", "0", "0", "0", "0", "7", "0.5833333", "0", "0", "133", "0.5683761"]


def test_statistics_add_up(spark, sf_dir):
    from seqloom.plans import queries as Q

    got = {r["sample"]: r for r in statistics(Q.run_all(spark, sf_dir)).collect()}
    total = got.pop("Total")
    for c in ("reads", "bases", "adapters", "trimmed"):
        assert sum(r[c] for r in got.values()) == total[c]


def test_simulated_reads_find_their_samples(spark):
    d = demux.Demux((demux.Sample("A", "ACGTACAA", ("TGCAG",)), demux.Sample("B", "TTGCCAGG", ("TGCAG",))), ONE)
    made = simulate_reads(spark, 400, d, 5, 60, Adapter.three("AGATCGGAAGAG"))
    got = made.join(process(made, Config(demux=d)).select("ord", "sample"), "ord")
    assert got.where("expected <> 'Undetermined' and expected <> sample").count() == 0
    assert 10 < got.where("expected = 'Undetermined'").count() < 90 and got.where("expected <> sample").count() < 8
    cut = process(made, Config(adapters=(Adapter.three("AGATCGGAAGAG"),), adapter_search=Search(Budget(0), overlap=3), adapter_offset=1000))
    both = made.join(cut.select("ord", "n_adapters"), "ord")
    assert both.where("has_adapter").count() > 100 and both.where("has_adapter and n_adapters = 0").count() == 0
    assert both.where("not has_adapter and n_adapters = 1").count() < 60  # three bases by chance, or what a wrong adapter's edits left
    assert simulate_reads(spark, 50, d, 5).collect() == simulate_reads(spark, 50, d, 5).collect()


def test_simulated_pairs_of_reads_find_their_samples(spark):
    samples = (demux.Sample("A", "ACGTACAATT", ("TGCAG", "TGGAG"), ("CAGC",), "GGTTAACCGA"), demux.Sample("B", "TTGCCAGGCA", ("TGCAG",), ("CTGC",), "CATGCATTGC"))
    d = demux.Demux(samples, ONE, check_reverse=True)
    made = simulate_reads(spark, 300, d, 7, 40, [Adapter.three("AGATCGGAAGAG")], r_adapter=Adapter.three("CCCCTTTTGGGG"), reverse=True, check_reverse=True, adapter_edits=1)
    got = made.join(process(made, Config(demux=d)).select("ord", "sample"), "ord")
    assert got.where("expected <> 'Undetermined' and expected <> sample").count() == 0 and got.where("expected <> sample").count() < 12
    assert 30 < got.where("expected = 'Undetermined'").count() < 90
    umis = simulate_reads(spark, 300, d, 7, 40, umi=8, reverse=True)
    by_index = process(umis, Config(demux=demux.Demux(samples, ONE), by_index=True)).select("ord", "sample").join(umis, "ord")
    assert by_index.where("expected <> 'Undetermined' and expected <> sample").count() == 0


def test_random_edits_and_qualities(spark):
    seq, n = "ACGTACGTAC", spark.range(300)
    got = n.select(random_edits(F.lit(seq), F.lit(1), False, 1, F.col("id")).alias("s"), random_edits(F.lit(seq), (F.col("id") % 4).cast("int"), True, 1, F.col("id")).alias("i"), random_quality(9, 1, F.col("id")).alias("q")).collect()
    assert all(len(r["s"]) == 10 and sum(a != b for a, b in zip(r["s"], seq, strict=True)) == 1 for r in got)
    assert {len(r["i"]) for r in got} == {7, 8, 9, 10, 11, 12, 13} and got[0]["i"] == seq
    assert {c for r in got for c in r["q"]} == set(map(chr, range(ord("0"), ord("A") + 1))) and all(len(r["q"]) == 9 for r in got)
    assert {(a, b) for r in got for a, b in zip(seq, r["s"], strict=True) if a != b} == {(a, b) for a in "ACGT" for b in "ACGT" if a != b}


def test_long_reads_come_in_small_slices(spark, monkeypatch):
    from seqloom.operators import arrow
    from seqloom.operators.trimming import adapter_trim

    rows = [(i, "AC" * (1 + i % 7) + "AGATCGGAAG", "I" * (2 * (1 + i % 7) + 10)) for i in range(60)] + [(60, "C" * 300_000 + "AGATCGGAAG", "I" * 300_010), (61, None, None), (62, "ACGTAGATCGGAAG", "II")]
    df = reads(spark, rows).coalesce(1)
    cut = lambda: {r["ord"]: r["f_seq"] for r in adapter_trim(df, "f_seq", "f_qual", [Adapter.three("AGATCGGAAG")], Search(Budget(1), overlap=5), 100).collect()}
    monkeypatch.setattr(arrow, "CELLS", 100)
    got = cut()
    assert got[60] == "C" * 300_000 and got[61] == "" and got[62] == "ACGT" and got[3] == "AC" * 4


def test_reads_without_a_umi_are_no_group(spark):
    df = spark.range(1000).select(F.col("id").alias("ord"), F.when(F.col("id") % 10 == 0, "ACGT").otherwise("A").alias("i1_seq"))
    marked = dedup.mark_duplicates(df, S.umi("i1_seq", 4), [], [F.col("ord")])
    assert marked.groupBy(F.spark_partition_id()).count().count() > 1 and marked.where("duplicate is null").count() == 900 and marked.where("duplicate").count() == 99


def test_a_large_sample_has_many_files_in_order(spark, tmp_path):
    df = spark.range(5000).select(F.when(F.col("id") < 4500, "hot").otherwise("a b/c").alias("sample"), F.col("id").alias("ord"), F.concat(F.lit("@"), "id").alias("header"), F.lit("AC").alias("seq"), F.lit("II").alias("qual"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be joined
    fastq.write_fastq(df, str(tmp_path / "out"), ["sample"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out/sample=hot").glob("part*"))) > 1
    back = fastq.read_written(spark, str(tmp_path / "out"), "sample").where("sample = 'hot'").orderBy("ord").collect()
    assert [(r["ord"], r["header"]) for r in back] == [(i, f"@{i}") for i in range(4500)]


def test_simulated_pairs_merge_as_expected(spark):
    made = simulate_pairs(spark, 120, 3).withColumn("f_qual", F.repeat(F.lit("A"), F.length("f_seq"))).withColumn("r_qual", F.col("f_qual"))
    assert {r["kind"] for r in made.collect()} == {0, 1, 2}
    done = process(made, Config(merge=True, merge_search=Search(Budget(1), overlap=20)))
    got = made.join(done.select("ord", F.col("f_seq").alias("got"), "n_merged"), "ord").collect()
    assert all(r["n_merged"] == 2 and len(r["got"]) == len(r["expected"]) for r in got if r["kind"] == 0)
    assert all(sum(a != b for a, b in zip(r["got"], r["expected"], strict=True)) <= 1 for r in got if r["kind"] == 0)
    assert sum(r["n_merged"] == 2 for r in got if r["kind"]) <= 6  # by chance, or edits that fell on one place


def test_scalar_functions(spark):
    row = spark.range(1).select(
        S.count_n(F.lit("ANnT")).alias("n"), S.share_n(F.lit("")).alias("empty"), S.mean_score(F.lit("")).alias("mean"), S.error_score(F.lit(0.1)).alias("q"),
        S.error_char(F.lit(1e-30)).alias("top"), S.hamming(F.lit("ACGT"), F.lit("AGGA")).alias("h"), S.decimal_text(F.lit(1234567.58333333)).alias("d"),
        S.reverse_complement(F.lit("ACGTNa")).alias("rc"),
    ).first()
    assert (row["n"], row["empty"], row["mean"], row["q"], row["top"], row["h"], row["d"], row["rc"]) == (2, 0.0, None, 10, "~", 2, "1,234,567.5833333", "tNACGT")
    assert S.duration_text(3_723_004) == "01:02:03.004"


def test_functions_by_name_in_sql(spark):
    from seqloom.functions.sql import register

    assert "hamming" in register(spark)
    row = spark.sql("select count_n('ANnT') n, share_n('') s, mean_score('') m, mean_score('II') q, round(error_sum('++'), 6) e, reverse_complement('ACGTNa') rc, hamming('ACGT', 'AGGA') h, umi('acgtAC', 4) u, phred_string(phred_scores('!I~')) p, decimal_text(1234.5) d").first()
    assert tuple(row) == (2, 0.0, None, 40.0, 0.2, "tNACGT", 2, "GTAC", "!I~", "1,234.5")
