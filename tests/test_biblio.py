"""The SQLite source: what the scan itself filters, how it is split, and what SQLite may hold."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, Not, StringEndsWith
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lectern.sources import biblio

ITEMS = StructType([StructField("itemID", LongType()), StructField("key", StringType()), StructField("itemTypeID", LongType()), StructField("dateModified", StringType())])


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "lib.sqlite")
    with sqlite3.connect(path) as db:
        for table, columns in biblio.SCHEMAS.items():
            names = [c.split()[0] for c in columns.split(", ")]
            db.execute(f"CREATE TABLE {table} ({', '.join(names)})")
        rows = [(i * 1_000_000, f"K{i}", i % 3, None if i % 5 == 0 else f"2020-01-{i % 28 + 1:02}") for i in range(1, 101)]
        db.executemany("INSERT INTO items (rowid, itemID, key, itemTypeID, dateModified) VALUES (?, ?, ?, ?, ?)", [(r[0], *r) for r in rows])
        db.executemany("INSERT INTO items (itemID, key, itemTypeID, dateModified) VALUES (?, ?, ?, ?)", [("none", "k1", 1, 7), (None, None, None, None), (5, "K'; --", 2, "\u00e9")])
    return path


WHERE = ["itemTypeID = 1", "key = 'K7'", "key = 'k1'", "key IN ('K1', 'K2', 'x')", "itemID > 50000000 AND itemTypeID <> 2", "dateModified IS NULL", "dateModified IS NOT NULL AND dateModified >= '2020-01-20'", "key LIKE 'K1%'", "key LIKE '%9%'", "key LIKE '%5'", "NOT itemTypeID IN (1, 2)", "key <=> null", "itemTypeID <=> 2", "key = \"K'; --\"", "dateModified = '7'", "itemID IS NULL", "length(key) = 2 AND itemTypeID = 0"]


@pytest.mark.parametrize("where", WHERE)
def test_filters_in_the_scan_change_nothing(spark, database, where):
    items = biblio.tables(spark, database)["items"]
    whole = spark.createDataFrame(items.collect(), items.schema)
    key = lambda rows: sorted(map(str, rows))
    assert key(items.where(where).collect()) == key(whole.where(where).collect())


def test_the_scan_holds_the_filter(spark, database):
    reader = biblio._Reader(database, "items", ITEMS)
    rest = list(reader.pushFilters([EqualTo(("itemTypeID",), 1), Not(EqualTo(("key",), "K4")), StringEndsWith(("key",), "7"), EqualTo(("itemID",), "x")]))
    assert [type(f).__name__ for f in rest] == ["StringEndsWith", "EqualTo"]
    assert reader.statement("*") == """SELECT * FROM "items" WHERE CASE WHEN typeof("itemTypeID") = 'integer' THEN "itemTypeID" END = ? AND NOT (CAST("key" AS TEXT) COLLATE BINARY = ?)""" and reader.values == [1, "K4"]
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(found) == 34 and all(r["itemTypeID"] == 1 for r in found)
    plan = biblio.tables(spark, database)["items"].where(F.col("itemTypeID") == 1)._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan  # nothing is left for Spark to apply


def test_sparse_ids_are_few_tasks(spark, database, monkeypatch):
    reader = biblio._Reader(database, "items", ITEMS)
    assert len(reader.partitions()) == 1  # of ids up to a hundred million
    monkeypatch.setattr(biblio, "ROWS_A_PART", 30)
    monkeypatch.setattr(biblio, "ROWS_A_BATCH", 7)
    parts = reader.partitions()
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sizes == [30, 30, 30, 13]
    assert biblio._Reader(database, "itemNotes", ITEMS).partitions() == []


def test_values_of_other_types(spark, database):
    rows = {r["key"]: r for r in biblio.tables(spark, database)["items"].where("itemID IS NULL OR itemID = 5").collect()}
    assert rows["k1"]["itemID"] is None and rows["k1"]["dateModified"] == "7" and rows["K'; --"]["dateModified"] == "\u00e9" and None in rows


def test_attributes_are_sorted_in_parts(spark, monkeypatch):
    """As many parts as rows need, whatever the splits of the input; no table of values is broadcast, though one small in its file may be large."""
    monkeypatch.setattr(biblio, "PIVOTED_A_PART", 50)
    fields = {biblio.TITLE: "title", biblio.ABSTRACT: "abstract_note", biblio.DATE: "date"}
    rows = [(i, f, f"v{i % 40}-{f}") for i in range(200) for f in (*fields, 99) if (i + f) % 3]
    values = sorted({(v, f"text {v}") for _, _, v in rows})
    found = biblio.pivoted(spark.createDataFrame(rows, "itemID long, fieldID long, valueID string").coalesce(1), spark.createDataFrame(values, "valueID string, value string").coalesce(1))
    kept = [r for r in rows if r[1] in fields]
    assert found.rdd.getNumPartitions() == -(-len(kept) // 50) > 4
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = {i: dict.fromkeys(fields.values()) for i, *_ in kept}
    for i, f, v in kept:
        want[i][fields[f]] = f"text {v}"
    assert {r["itemID"]: {n: r[n] for n in fields.values()} for r in found.collect()} == want
    none = biblio.pivoted(spark.createDataFrame([], "itemID long, fieldID long, valueID string"), spark.createDataFrame(values, "valueID string, value string"))
    assert none.collect() == []
