"""Command line: reads in, one FASTQ folder for each sample and a report out."""

from __future__ import annotations

import argparse
import contextlib
import threading
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import duration_text
from .operators import stats
from .operators.demux import Demux, Sample
from .operators.kernels import FULL, Adapter, Budget, Search
from .plans.config import NO_LIMIT, Config
from .plans.process import process, statistics
from .plans.simulate import simulate_pairs, simulate_reads
from .sources import enzymes, fastq


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqloom", description="Filters, demultiplexes, trims, merges and deduplicates sequencing reads on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("process")
    r.add_argument("-r", "--reads", nargs="+", required=True, metavar="FILE", help="forward and, of pairs, reverse reads")
    r.add_argument("-i", "--index", nargs="+", default=[], metavar="FILE", help="forward and reverse index reads")
    r.add_argument("-o", "--out", help="the folder of the forward reads by default")
    r.add_argument("-s", "--samples", help="sample sheet: name, barcode, enzyme [reverse enzyme [reverse barcode]]")
    r.add_argument("-E", "--enzyme", nargs="+", default=[], help="name and sequence of further enzyme remnants, in turn")
    r.add_argument("-u", "--umi", type=int, default=12)
    r.add_argument("-dF", "--dedup-first", action="store_true")
    r.add_argument("-dB", "--dedup-best", action="store_true")
    r.add_argument("--save-dup", action="store_true", help="writes the reads that deduplication drops to dup, pairs side by side")
    r.add_argument("--save-temp", action="store_true", help="keeps the table of all records, before deduplication drops any, in temp")
    r.add_argument("--print-processed", type=float, metavar="SECONDS", help="prints finished and all tasks of the running stages that often")
    r.add_argument("-N", "--most-n", nargs="?", type=float, const=-1.0, default=2.0, help="share of Ns; alone: none at all")
    r.add_argument("-Q", "--quality", type=float, default=0.0)
    r.add_argument("--alt-quality-filter", action="store_true", help="-Q is then the most expected errors")
    r.add_argument("-fB", "--barcode-offset", type=int, default=0)
    r.add_argument("-fA", "--adapter-offset", type=int, default=0)
    r.add_argument("-eA", "--adapter-edits", type=float, default=1)
    r.add_argument("-eB", "--barcode-edits", type=float, default=1)
    r.add_argument("-eM", "--merge-edits", type=float, default=1)
    r.add_argument("-vA", "--adapter-overlap", type=int, default=3)
    r.add_argument("-vB", "--barcode-overlap", type=int, default=FULL)
    r.add_argument("-vM", "--merge-overlap", type=int, default=3)
    r.add_argument("-lA", "--adapter-indels", action="store_true")
    r.add_argument("-lB", "--barcode-indels", action="store_true")
    r.add_argument("-pA", "--adapter-prior", nargs="?", type=float, const=0.5)
    r.add_argument("-pB", "--barcode-prior", nargs="?", type=float, const=0.5)
    r.add_argument("-pM", "--merge-prior", nargs="?", type=float, const=0.5)
    r.add_argument("-tB", "--trim-barcode", action="store_true")
    r.add_argument("-tE", "--trim-enzyme", action="store_true")
    for flag, text in (("-a", "5' adapters of forward reads, ^ anchors"), ("-A", "3' adapters of forward reads, $ anchors"), ("-z", "5' adapters of reverse reads"), ("-Z", "3' adapters of reverse reads")):
        r.add_argument(flag, nargs="+", default=[], help=text)
    r.add_argument("-q", "--quality-trim", nargs="+", type=int, default=[0], help="3' threshold, or 5' and 3'")
    r.add_argument("--alt-quality-trim", action="store_true")
    r.add_argument("--quality-trim-length", type=int)
    r.add_argument("-n", "--n-trim", nargs="?", type=float, const=0.5, default=2.0)
    r.add_argument("-m", "--merge", action="store_true")
    r.add_argument("--min", type=int, default=0)
    r.add_argument("--max", type=int, default=NO_LIMIT)
    r.add_argument("-R", "--check-reverse", action="store_true")
    r.add_argument("-S", "--single-barcode", action="store_true")
    r.add_argument("-w", "--wildcard", action="store_true")
    r.add_argument("-tQ", "--must-trim", action="store_true")
    r.add_argument("-tA", "--must-adapter", action="store_true")
    r.add_argument("-tM", "--must-merge", action="store_true")
    r.add_argument("-gz", "--gzip", action="store_true")
    r.add_argument("--clear-dir", action="store_true")
    r.add_argument("--strict", action="store_true")
    s = sub.add_parser("simulate")
    s.add_argument("-o", "--out", required=True)
    s.add_argument("-s", "--samples")
    s.add_argument("-E", "--enzyme", nargs="+", default=[])
    s.add_argument("-A", dest="adapters", nargs="+", default=[], help="3' adapters of forward reads")
    s.add_argument("-Z", dest="r_adapters", nargs="+", default=[], help="3' adapters of reverse reads")
    s.add_argument("-eB", "--barcode-edits", type=float, default=1)
    s.add_argument("-eA", "--adapter-edits", type=float, default=1)
    s.add_argument("-eM", "--merge-edits", type=float, default=1)
    s.add_argument("-lB", "--barcode-indels", action="store_true")
    s.add_argument("-lA", "--adapter-indels", action="store_true")
    s.add_argument("-vA", "--adapter-overlap", type=int, default=3)
    s.add_argument("-vM", "--merge-overlap", type=int, default=20)
    s.add_argument("-R", "--check-reverse", action="store_true")
    s.add_argument("--reversed", action="store_true", help="pairs")
    s.add_argument("--iter", type=int, default=1000)
    s.add_argument("--len", type=int, default=100)
    s.add_argument("--umi", nargs="?", type=int, const=12)
    s.add_argument("--merging", action="store_true", help="pairs that overlap, or nearly do")
    s.add_argument("--clear-dir", action="store_true")
    s.add_argument("--seed", type=int, required=True)
    return p


def sample_rows(spark: SparkSession, path: str, extra: list[str]) -> tuple[Sample, ...]:
    """The sample sheet, which is small by nature, as plan-time parameters."""
    known = enzymes.enzymes(spark, list(zip(extra[::2], extra[1::2], strict=True)))
    sheet = enzymes.with_remnants(fastq.read_sample_sheet(spark, path), known).collect()
    return tuple(Sample(r["name"], r["barcode"], tuple(r["remnants"]), tuple(r["r_remnants"]), r["r_barcode"]) for r in sheet)


def config_of(a: argparse.Namespace, samples: tuple[Sample, ...]) -> Config:
    three = a.quality_trim[-1]
    five = a.quality_trim[0] if len(a.quality_trim) > 1 else 0
    window = a.quality_trim_length if a.quality_trim_length is not None else None if a.alt_quality_trim else 1
    how = Search(Budget.of(a.barcode_edits), a.barcode_indels, a.barcode_overlap, a.wildcard, a.barcode_prior)
    demux = Demux(samples, how, a.barcode_offset, a.check_reverse, a.single_barcode, a.umi) if samples else None
    return Config(
        demux=demux, by_index=bool(a.index), most_n=2.0 if a.most_n < 0 else a.most_n, no_n=a.most_n < 0,
        quality=0.0 if a.alt_quality_filter else a.quality, errors=a.quality if a.alt_quality_filter else None,
        trim_barcode=a.trim_barcode, trim_enzyme=a.trim_enzyme, trim_n=a.n_trim, quality_five=five, quality_three=three, window=window, running=a.alt_quality_trim,
        adapters=tuple([*map(Adapter.five, a.a), *map(Adapter.three, a.A)]), r_adapters=tuple([*map(Adapter.five, a.z), *map(Adapter.three, a.Z)]),
        adapter_search=Search(Budget.of(a.adapter_edits), a.adapter_indels, a.adapter_overlap, a.wildcard, a.adapter_prior), adapter_offset=a.adapter_offset,
        merge=a.merge, merge_search=Search(Budget.of(a.merge_edits), False, a.merge_overlap, a.wildcard, a.merge_prior),
        least_length=a.min, most_length=a.max, must_trim=a.must_trim, must_adapter=a.must_adapter, must_merge=a.must_merge,
        dedup="first" if a.dedup_first else "best" if a.dedup_best else None, umi=a.umi, strict=a.strict,
    )


def folder(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def prepare(spark: SparkSession, out: str, names: list[str], clear: bool) -> None:
    """An empty place for each output, before any work: what is there goes with --clear-dir, and is an error without it."""
    if clear:
        target, fs = folder(spark, out)
        fs.delete(target, True)
    for name in names:
        target, fs = folder(spark, f"{out}/{name}")
        if fs.exists(target):
            raise SystemExit(f"{out}/{name} exists; --clear-dir deletes it")


def count_files(spark: SparkSession, path: str) -> int:
    """Data files below a folder."""
    target, fs = folder(spark, path)
    if not fs.exists(target):
        return 0
    each, n = fs.listFiles(target, True), 0
    while each.hasNext():
        n += each.next().getPath().getName().startswith("part-")
    return n


def write_reads(done: DataFrame, a: argparse.Namespace, config: Config) -> None:
    mates = [m for m in ("f", "r") if f"{m}_seq" in done.columns and not (m == "r" and config.merge)]
    kept = done if config.dedup is None else done.where("duplicate is null and not kept or not duplicate")
    for m in [*mates, *[i for i in ("i1", "i2") if f"{i}_header" in done.columns]]:
        fastq.write_fastq(kept, f"{a.out}/{m}", ["sample"], f"{m}_header", f"{m}_seq", f"{m}_qual", gz=a.gzip)
    if config.dedup is not None and a.save_dup:
        again = done.where("duplicate")
        if "r" in mates:
            fastq.write_pairs(again, f"{a.out}/dup", ["sample"], gz=True)
        else:
            fastq.write_fastq(again, f"{a.out}/dup", ["sample"], "f_header", "f_seq", "f_qual", gz=True)


def write_log(spark: SparkSession, a: argparse.Namespace, totals: dict[str, int], began: float) -> None:
    """Parameters, run time and totals."""
    lines = [f"{k}: {v}" for k, v in sorted(vars(a).items())]
    lines += [f"Run time: {duration_text(1000 * (time.time() - began))}", *[f"{k}: {v}" for k, v in totals.items()]]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{a.out}/log")


@contextlib.contextmanager
def progress(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Prints how many tasks of the running stages are done, every so many seconds."""
    stop = threading.Event()

    def watch() -> None:
        tracker = spark.sparkContext.statusTracker()
        while not stop.wait(seconds):
            stages = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x]
            print(f"{sum(x.numCompletedTasks for x in stages)} of {sum(x.numTasks for x in stages)} tasks", flush=True)

    thread = threading.Thread(target=watch, daemon=True)
    if seconds:
        thread.start()
    try:
        yield
    finally:
        stop.set()


def run_process(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reads become a table of records in `temp`, once; files, duplicates, report and log come from it."""
    began = time.time()
    if (a.dedup_first or a.dedup_best) and not a.index:
        raise SystemExit("deduplication needs index reads (-i)")
    a.out = a.out or (a.reads[0].rsplit("/", 1)[0] if "/" in a.reads[0] else ".")
    prepare(spark, a.out, ["f", "r", "i1", "i2", "dup", "stats", "log", "temp"], a.clear_dir)
    files = [fastq.read_reads(spark, f, a.strict) for f in [*a.reads[:2], *a.index[:2]]]
    pair = len(a.reads) > 1
    df = fastq.join_files(files[0], files[1] if pair else None, *files[1 + pair :])
    samples = sample_rows(spark, a.samples, a.enzyme) if a.samples else ()
    config = config_of(a, samples)
    process(df, config).write.parquet(f"{a.out}/temp")
    done = spark.read.parquet(f"{a.out}/temp")
    write_reads(done, a, config)
    sheet = {s.name: (s.barcode, s.r_barcode) for s in samples}
    shared = statistics(done)
    lines = stats.report(shared, sheet).coalesce(1).sortWithinPartitions("n")  # one line a sample
    lines.select("line").write.text(f"{a.out}/stats")
    total = shared.where("sample = 'Total'").first()
    n = {k: total[k] if total else 0 for k in ("reads", "duplicates")}
    kept = ["f", "r", "i1", "i2"]
    write_log(spark, a, {"Reads": n["reads"], "Lines": 4 * n["reads"], "Duplicates": n["duplicates"], "Files of reads": sum(count_files(spark, f"{a.out}/{m}") for m in kept), "Files of duplicates": count_files(spark, f"{a.out}/dup")}, began)
    if not a.save_temp:
        target, fs = folder(spark, f"{a.out}/temp")
        fs.delete(target, True)


def run_simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Reads in f, r, i1 and i2; what a run should make of them in results, by sample, and the counts in the log."""
    began = time.time()
    prepare(spark, a.out, ["f", "r", "i1", "i2", "results", "expected", "log"], a.clear_dir)
    if a.merging:
        made = simulate_pairs(spark, a.iter, a.seed, a.len, a.merge_overlap, int(a.merge_edits)).withColumn("header", F.concat(F.lit("@sim"), "ord"))
        results = made.where("kind = 0").select("ord", "header", F.col("expected").alias("f_seq"), F.lit("merged").alias("sample"))
        counts = {"Reads": 2 * a.iter, "Merged reads": 2 * results.count()}
    else:
        d = Demux(sample_rows(spark, a.samples, a.enzyme), Search(Budget.of(a.barcode_edits)))
        made = simulate_reads(
            spark, a.iter, d, a.seed, a.len, [*map(Adapter.three, a.adapters)], overlap=a.adapter_overlap, umi=a.umi, r_adapter=[*map(Adapter.three, a.r_adapters)], reverse=a.reversed, check_reverse=a.check_reverse,
            barcode_edits=int(a.barcode_edits), barcode_indels=a.barcode_indels, adapter_edits=int(a.adapter_edits), adapter_indels=a.adapter_indels,
        )
        results = made.withColumnRenamed("expected", "sample")
        mates = 2 if a.reversed else 1
        flags = sum((F.col(c).cast("int") for c in ("has_adapter", "r_has_adapter") if c in made.columns), F.lit(0))
        by = results.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum(flags).alias("adapters")).collect()  # a row for each sample
        counts = {f"Reads of {r['sample']}": mates * r["n"] for r in by} | {f"Adapters in {r['sample']}": r["adapters"] for r in by} | {"Reads": mates * a.iter}
    made.write.parquet(f"{a.out}/expected")
    qual = lambda df, m: F.col(f"{m}_qual") if f"{m}_qual" in df.columns else F.repeat(F.lit("A"), F.length(f"{m}_seq"))
    for m in ("f", "r", "i1", "i2"):
        if f"{m}_seq" in made.columns:
            fastq.write_fastq(made.select("ord", "header", F.col(f"{m}_seq").alias("seq"), qual(made, m).alias("qual"), F.lit(m).alias("file")), f"{a.out}/{m}", ["file"])
        if m in ("f", "r") and f"{m}_seq" in results.columns:
            fastq.write_fastq(results.select("sample", "ord", "header", F.col(f"{m}_seq").alias("seq"), F.repeat(F.lit("A"), F.length(f"{m}_seq")).alias("qual")), f"{a.out}/results/{m}", ["sample"])
    write_log(spark, a, counts, began)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqloom").getOrCreate()
    with progress(spark, getattr(a, "print_processed", None)):
        run_process(spark, a) if a.command == "process" else run_simulate(spark, a)
