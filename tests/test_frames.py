"""GROUPS and EXCLUDE against an engine that has them."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.plans import frames, sqlgate
from lectern.plans.match import Denied


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([1, 2, 2, 3, 5, 8, None]), rng.choice([None, *range(20)])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, p string, o int, x long")
    df.createOrReplaceTempView("framed_rows")
    c = duckdb.connect()
    c.register("framed_rows", df.toPandas().astype({"o": "Int32", "x": "Int64"}))
    return c


BOUNDS = [("UNBOUNDED PRECEDING", "CURRENT ROW"), ("1 PRECEDING", "1 FOLLOWING"), ("CURRENT ROW", "2 FOLLOWING"), ("2 PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", "UNBOUNDED FOLLOWING"), ("UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING"), ("0 PRECEDING", "0 FOLLOWING")]


def compared(spark, c, kind, without, names, order="o NULLS FIRST"):
    """All bounds and aggregates in one statement of each engine."""
    cells = [f"{name}(x) OVER (PARTITION BY p ORDER BY {order} {kind} BETWEEN {a} AND {b} {without}) AS c{i}" for i, ((a, b), name) in enumerate(itertools.product(BOUNDS, names))]
    sql = f"SELECT id, {', '.join(cells)} FROM framed_rows AS r WHERE id % 9 <> 4"
    got = sqlgate.search(spark, sql).orderBy("id").collect()
    number = lambda v: None if v is None or v != v else round(float(v), 9)
    assert [[number(v) for v in r] for r in got] == [[number(v) for v in r] for r in c.execute(sql + " ORDER BY id").fetchall()]


@pytest.mark.parametrize("without", ["", "EXCLUDE NO OTHERS", "EXCLUDE CURRENT ROW", "EXCLUDE GROUP", "EXCLUDE TIES"])
def test_groups(spark, both, without):
    compared(spark, both, "GROUPS", without, ("sum", "count", "avg", "min", "max"))


@pytest.mark.parametrize("without", ["EXCLUDE CURRENT ROW", "EXCLUDE GROUP", "EXCLUDE TIES"])
def test_range(spark, both, without):
    compared(spark, both, "RANGE", without, ("sum", "count", "avg"), "coalesce(o, 0)")


def test_rows(spark, both):
    compared(spark, both, "ROWS", "EXCLUDE CURRENT ROW", ("sum", "count", "avg", "min", "max"), "id DESC")


def test_where_windows_stand(spark, both):
    for sql in (
        "SELECT *, round(sum(x) OVER (ORDER BY o DESC NULLS LAST, p GROUPS 1 PRECEDING), 1) AS s FROM framed_rows",
        "WITH w AS (SELECT id, count(*) OVER (ORDER BY p GROUPS BETWEEN CURRENT ROW AND 1 FOLLOWING EXCLUDE TIES) AS n FROM (SELECT * FROM framed_rows WHERE x > 3)) SELECT n, count(*) AS m FROM w GROUP BY n UNION ALL SELECT id, count(*) OVER (ORDER BY id GROUPS 2 PRECEDING) FROM framed_rows WHERE id < 9",
        "SELECT r.id, coalesce(sum(r.x) OVER (PARTITION BY r.p, r.o ORDER BY r.x NULLS FIRST GROUPS BETWEEN 1 PRECEDING AND 1 PRECEDING), -1) AS s FROM framed_rows r ORDER BY r.id LIMIT 20",
    ):
        key = lambda rows: sorted(str([None if v is None else float(v) if not isinstance(v, str) else v for v in r]) for r in rows)
        want = [[None if v != v else v for v in r] for r in both.execute(sql).fetchall()]
        assert key(map(tuple, sqlgate.search(spark, sql).collect())) == key(want), sql


@pytest.mark.parametrize("sql", [
    "SELECT sum(a) OVER (PARTITION BY b GROUPS 1 PRECEDING) FROM t", "SELECT first_value(a) OVER (ORDER BY b GROUPS 1 PRECEDING) FROM t", "SELECT sum(a) OVER (ORDER BY b GROUPS 1 PRECEDING) FROM t JOIN u USING (b)",
    "SELECT sum(a) OVER (ORDER BY b ROWS 1 PRECEDING EXCLUDE TIES) FROM t", "SELECT min(a) OVER (ORDER BY b RANGE 1 PRECEDING EXCLUDE GROUP) FROM t",
])
def test_what_cannot_be_is_refused(sql):
    with pytest.raises(Denied):
        frames.replaced(sql)


def test_other_statements_stay():
    for sql in ("SELECT groups FROM t", "SELECT sum(a) OVER (ORDER BY b ROWS 1 PRECEDING) FROM t", "SELECT * EXCEPT (a) FROM t", "SELECT exclude, rows FROM range"):
        assert frames.replaced(sql) == sql


def test_frames_of_groups_are_made_over_sums_of_peers(spark):
    rows = spark.range(30_000).selectExpr("id", "CAST(id % 2 AS STRING) AS p", "CAST(IF(id % 3 = 0, NULL, id % 5) AS INT) AS o")
    rows.createOrReplaceTempView("framed_copies")
    sql = "SELECT r.*, sum(r.id) OVER (ORDER BY p GROUPS 1 PRECEDING) AS s, min(id) OVER (PARTITION BY p ORDER BY o DESC GROUPS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after, count(o, id) OVER (ORDER BY o GROUPS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS n FROM framed_copies r"
    assert "dense_rank" not in frames.replaced(sql)  # no task has to number all rows, and no row adds up its frame anew
    found = sqlgate.search(spark, sql)
    assert found.columns == ["id", "p", "o", "s", "after", "n"]
    table = rows.toPandas()
    total = {p: int(table[table.p <= p].id.sum()) for p in "01"}
    number = table.o.value_counts().to_dict()
    least = {p: table[table.p == p].groupby("o", dropna=False).id.min().to_dict() for p in "01"}
    for r in found.where("id % 97 = 0 OR id > 29950").collect():
        assert r["s"] == total[r["p"]]
        below = [v for k, v in least[r["p"]].items() if r["o"] is not None and (k != k or k < r["o"])]
        assert r["after"] == (min(below) if below else None)
        assert r["n"] == number.get(0.0 if r["o"] is None else r["o"] + 1.0, 0)


def test_relations_that_may_change_are_read_once(spark, both):
    sql = "WITH w AS (SELECT * FROM framed_rows ORDER BY id LIMIT 40) SELECT id, sum(x) OVER (PARTITION BY p ORDER BY o NULLS FIRST GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS s FROM w"
    assert "JOIN" not in frames.replaced(sql) and "JOIN" in frames.replaced(sql.replace("LIMIT 40", ""))
    number = lambda v: None if v is None or v != v else int(v)
    assert sorted((r["id"], r["s"]) for r in sqlgate.search(spark, sql).collect()) == sorted((i, number(s)) for i, s in both.execute(sql).fetchall())


def test_exclude_in_large_groups_of_peers(spark):
    """Each of 20,000 peers is left out in turn; the second least stands in for the least only where that is one row's."""
    rows = spark.range(40_000).selectExpr("id", "CAST(id % 2 AS STRING) AS p", "CASE WHEN id < 4 THEN IF(id % 2 = 0, 1, id + 1) WHEN id % 5 > 0 THEN 9 + id END AS x")
    rows.createOrReplaceTempView("framed_peers")
    sql = "SELECT id, p, x, min(x) OVER (ORDER BY p GROUPS BETWEEN CURRENT ROW AND CURRENT ROW EXCLUDE CURRENT ROW) AS least, max(x) OVER (ORDER BY p GROUPS CURRENT ROW EXCLUDE CURRENT ROW) AS most, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING EXCLUDE TIES) AS n FROM framed_peers"
    assert " ROWS BETWEEN" not in frames.replaced(sql).split("AS least")[0].split("FROM")[0]
    for r in sqlgate.search(spark, sql).where("id < 20 OR id > 39980").collect():
        p = int(r["p"])
        values = sorted((1 if p == 0 else i + 1) if i < 4 else 9 + i for i in range(p, 40_000, 2) if i < 4 or i % 5)
        if r["x"] is not None:
            values.remove(r["x"])
        assert (r["least"], r["most"], r["n"]) == (values[0], values[-1], p * 20_000 + 1)


@pytest.fixture
def sixteen(spark):
    """As many parts as tasks, though there are few rows."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_frames_of_rows_are_dealt_out(spark, sixteen, tmp_path):
    """Of 4,000 rows 3,900 are of one partition: no task has them all, and frames that reach over a cut, or over many small parts, lack no row."""
    rows = spark.range(4_000).selectExpr("id * 7919 % 4001 AS id", "CASE WHEN id % 40 > 0 THEN 'a' WHEN id % 80 > 0 THEN 'b' END AS p", "CASE WHEN id % 7 > 0 THEN id * 7919 % 10007 END AS x", "CASE WHEN id % 3 > 0 THEN id % 50 END AS o")
    rows.write.parquet(path := str(tmp_path / "rows"))
    spark.read.parquet(path).createOrReplaceTempView("framed_parts")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW framed_parts AS SELECT * FROM '{path}/*.parquet'")
    number = lambda v: None if v is None else round(float(v), 6)
    for bounds in (("BETWEEN 3 PRECEDING AND 2 FOLLOWING", "BETWEEN 3 PRECEDING AND 2 PRECEDING", "BETWEEN CURRENT ROW AND CURRENT ROW"), ("1 PRECEDING",), ("BETWEEN 1 FOLLOWING AND 4 FOLLOWING",), ("BETWEEN 300 PRECEDING AND 30 FOLLOWING",)):
        calls = [f"{name}(x) OVER (PARTITION BY p ORDER BY {{}} ROWS {b} EXCLUDE CURRENT ROW)" for name in ("sum", "max", "count") for b in bounds]
        for order in ("o NULLS FIRST, id DESC", "id DESC", "id", "o DESC NULLS LAST, id DESC", "o DESC NULLS FIRST, id", "o NULLS LAST, id")[: 6 if len(bounds) > 1 else 1]:
            sql = f"SELECT id, {', '.join(f'{call.format(order)} AS c{i}' for i, call in enumerate(calls))} FROM framed_parts r WHERE r.id % 9 <> 4"
            assert [[number(v) for v in r] for r in sqlgate.search(spark, sql).orderBy("id").collect()] == [[number(v) for v in r] for r in c.execute(sql + " ORDER BY id").fetchall()], (bounds, order)
    found = sqlgate.search(spark, "SELECT *, sum(x) OVER (PARTITION BY p ORDER BY id ROWS 3 PRECEDING EXCLUDE CURRENT ROW) AS s FROM framed_parts")
    assert found.columns == ["id", "p", "x", "o", "s"]
    assert max(r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("s")).collect()) < 2_000


def test_frames_of_rows_over_frames_of_rows(spark, sixteen, both):
    sql = "WITH w AS (SELECT *, sum(x) OVER (ORDER BY id ROWS 1 PRECEDING EXCLUDE CURRENT ROW) AS y FROM framed_rows) SELECT id, sum(y) OVER (PARTITION BY p ORDER BY o NULLS FIRST GROUPS 1 PRECEDING) AS s, max(y) OVER (ORDER BY id DESC ROWS 2 PRECEDING EXCLUDE CURRENT ROW) AS m, min(x) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING EXCLUDE CURRENT ROW) AS u FROM w"
    assert "dense_rank" not in frames.replaced(sql)
    number = lambda v: None if v is None or v != v else int(v)
    assert sorted([number(v) for v in r] for r in sqlgate.search(spark, sql).collect()) == sorted([number(v) for v in r] for r in both.execute(sql).fetchall())
    both_there = "SELECT id, count({}) OVER (ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS n FROM framed_rows ORDER BY id"
    assert [tuple(r) for r in sqlgate.search(spark, both_there.format("o, x")).collect()] == both.execute(both_there.format("CASE WHEN o IS NOT NULL AND x IS NOT NULL AND x = x THEN 1 END")).fetchall()
