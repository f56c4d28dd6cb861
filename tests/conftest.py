from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir):
    """Asserts that a registered query and its SQL give the same rows."""
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")

    def check(query, sql: str) -> None:
        df = query(spark, sf_dir)
        cols = sorted(df.columns)
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
        rel = con.execute(sql)
        names = [c[0] for c in rel.description]
        assert sorted(names) == cols
        want = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=str)
        assert got == want

    return check
