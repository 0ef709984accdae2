"""Every query against the same in SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import catalog
from lectern.session import TABLES


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(names, table):
    return sorted((tuple(map(str, r)) for r in table))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    found = duck.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(names, df.select(*(f"`{n}`" for n in names)).collect()) == rows(names, found.fetchall())


def test_contract(spark):
    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned(spark, small):
    plan = catalog.QUERIES["agg_having"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan
    plan = catalog.QUERIES["hybrid_prefilter"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)" in plan or "EqualTo(lang,en)" in plan
    plan = catalog.QUERIES["knn_l2_topk"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
