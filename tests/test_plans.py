"""Every plan that has a SQL twin gives the same rows as DuckDB; plans without one run and keep their schema."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.queries() if n != "pipeline" and not n.startswith("op"))


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql:
        assert not difference(df, duck, sql)
    else:
        assert df.schema == entry.queries()[name](spark, SF).schema and df.count() >= 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and {r["rank_credible"] for r in rows} == set(range(1, 21))


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
