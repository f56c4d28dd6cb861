from __future__ import annotations

import pytest

from seqloom.plans import more_queries  # noqa: F401
from seqloom.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(name, same_rows):
    same_rows(Q.QUERIES[name], Q.ORACLE_SQL[name])


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)):
        assert Q.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
