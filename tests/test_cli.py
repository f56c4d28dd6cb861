"""The command line and the stream, end to end."""

from __future__ import annotations

import gzip

import pytest

from seqloom import cli
from seqloom.operators.kernels import Adapter, Budget, Search
from seqloom.plans.config import Config
from seqloom.streaming.reads import distinct_umis, read_stream, write_stream

ADAPTER_READS = ["AAAAAAAATCGGTCA", "ATCGGTCAAAAAAAA", "CGGTCAAAAAAAAA"]


def fastq(path, seqs):
    path.write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)))
    return str(path)


def text_of(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part*")))


def test_adapters_from_the_command_line(spark, tmp_path):
    reads = fastq(tmp_path / "in.fastq", ADAPTER_READS)
    cli.main(["process", "-r", reads, "-o", str(tmp_path / "out"), "-A", "ATCGGTCA", "-vA", "5", "-eA", "1", "-lA", "-fA", "100"])
    assert text_of(tmp_path / "out/f/sample=Kept").split("\n")[1:12:4] == ["AAAAAAA", "", "CGGTCAAAAAAAAA"]
    lines = text_of(tmp_path / "out/stats").split("\n")
    assert lines[1].split()[:3] == ["Kept", "3", "1"] and lines[3].startswith("Total")


def test_samples_pairs_and_umis_from_the_command_line(spark, tmp_path):
    (tmp_path / "sheet").write_text("A ACGTAC PSTI\nB TTGCCA PSTI\n")
    f = fastq(tmp_path / "f.fastq", ["ACGTACTGCAGTTTTAAAA", "TTGCCATGCAGCCCCGGGG", "ACGTACTGCAGTTTTAAAA", "GGGGGGGGGGGGGGGGGGG"])
    i = fastq(tmp_path / "i.fastq", ["ACGTACAAAA", "TTGCCACCCC", "ACGTACAAAA", "GGGGGGTTTT"])
    cli.main(["process", "-r", f, "-i", i, "-s", str(tmp_path / "sheet"), "-o", str(tmp_path / "out"), "-u", "4", "-dF", "--save-dup"])
    assert text_of(tmp_path / "out/f/sample=A").count("@") == 1 and text_of(tmp_path / "out/f/sample=B").count("@") == 1
    assert text_of(tmp_path / "out/f/sample=Undetermined").count("@") == 1
    assert (tmp_path / "out/dup/sample=A").is_dir() and "Reads: 4" in text_of(tmp_path / "out/log")


def test_outputs_are_checked_before_any_work(spark, tmp_path, capsys):
    reads = fastq(tmp_path / "in.fastq", ADAPTER_READS)
    cli.main(["process", "-r", reads, "--save-temp", "--print-processed", "0.01"])  # the folder of the reads
    assert spark.read.parquet(str(tmp_path / "temp")).count() == 3 and "tasks" in capsys.readouterr().out
    log = text_of(tmp_path / "log")
    assert "Files of reads: 1" in log and "Duplicates: 0" in log and "Files of duplicates: 0" in log
    with pytest.raises(SystemExit, match="exists"):
        cli.main(["process", "-r", reads])
    cli.main(["process", "-r", "file://" + reads, "-o", str(tmp_path / "again"), "--strict"])  # by Spark's own reader
    assert text_of(tmp_path / "again/f/sample=Kept") == text_of(tmp_path / "f/sample=Kept") and not (tmp_path / "again/temp").exists()
    cli.main(["process", "-r", reads, "-o", str(tmp_path / "again"), "--clear-dir"])
    assert text_of(tmp_path / "again/f/sample=Kept") == text_of(tmp_path / "f/sample=Kept")


def test_duplicates_of_pairs_stand_side_by_side(spark, tmp_path):
    f, r, i = fastq(tmp_path / "f.fastq", ["ACGT", "ACGA"]), fastq(tmp_path / "r.fastq", ["TTTT", "TTTA"]), fastq(tmp_path / "i.fastq", ["AAAA", "AAAA"])
    cli.main(["process", "-r", f, r, "-i", i, "-o", str(tmp_path / "out"), "-u", "4", "-dF", "--save-dup"])
    [path] = (tmp_path / "out/dup/sample=Kept").glob("part*")
    assert gzip.open(path, "rt").read().split("\n")[1:8:4] == ["ACGA", "TTTA"]


def test_simulate_from_the_command_line(spark, tmp_path):
    (tmp_path / "sheet").write_text("A ACGTACGTTA PSTI\nB TTGCCAGGCC PSTI APEKI GGCATTACAG\n")
    cli.main(["simulate", "-s", str(tmp_path / "sheet"), "-o", str(tmp_path / "out"), "--iter", "20", "--seed", "3", "--umi", "--reversed"])
    made = spark.read.parquet(str(tmp_path / "out/expected"))
    assert made.count() == 20 and {"i1_seq", "i2_seq", "r_seq"} <= set(made.columns)
    flags = ["-A", "AGATCGGAAGAG", "-Z", "TTTTGGGGCCCC", "-eB", "2", "-eA", "1", "-lB", "-lA", "-vA", "5", "-R", "--reversed"]
    cli.main(["simulate", "-s", str(tmp_path / "sheet"), "-o", str(tmp_path / "both"), "--iter", "50", "--seed", "3", *flags])
    log = text_of(tmp_path / "both/log")
    assert "Reads: 100" in log and "Reads of A:" in log and "Adapters in B:" in log
    results = sum(text_of(p).count("@sim") for p in (tmp_path / "both/results/r").glob("sample=*"))
    assert results == 50 and (tmp_path / "both/results/f/sample=Undetermined").is_dir()
    cli.main(["simulate", "--merging", "-o", str(tmp_path / "pairs"), "--iter", "30", "--seed", "3"])
    assert (tmp_path / "pairs/r/file=r").is_dir() and "Merged reads: " in text_of(tmp_path / "pairs/log")


def test_stream_writes_samples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fastq(tmp_path / "in/a.fastq", ADAPTER_READS)
    config = Config(adapters=(Adapter.three("ATCGGTCA"),), adapter_search=Search(Budget(1), True, 5), adapter_offset=100)
    query = write_stream(read_stream(spark, str(tmp_path / "in")), config, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert text_of(tmp_path / "out/batch=0/sample=Kept").split("\n")[1:12:4] == ["AAAAAAA", "", "CGGTCAAAAAAAAA"]


def test_stream_keeps_one_read_of_each_umi(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:0{i}", s) for i, s in enumerate(["AAACC", "TTACC", "GGACG", "A"])]
    spark.createDataFrame(rows, "t string, i1_seq string").selectExpr("cast(t as timestamp) as t", "i1_seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, i1_seq string").parquet(str(tmp_path / "in"))
    query = distinct_umis(stream, "i1_seq", 3, "t", "1 hour").writeStream.format("memory").queryName("umis").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["umi"] for r in spark.table("umis").collect()) == ["ACC", "ACG"]
