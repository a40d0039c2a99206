"""Every query of the catalogue against the SQL it equals, and the driver's entry points."""

from __future__ import annotations

from pathlib import Path

import pytest

from orthoplex import operator_queries
from orthoplex import queries as catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(repr(tuple(r[k] for k in order)) for r in rows)


QUERIES, SQL = catalogue.queries() | operator_queries.queries(), catalogue.oracle_sql() | operator_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(SQL[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in got.description], got.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushed_to_the_scan(spark):
    df = catalogue.queries()["q02_total_slicer"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_comment" not in plan
