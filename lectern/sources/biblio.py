"""A bibliographic SQLite database as a Spark source, and the tables it gives: items, authors, attachments, annotations, notes."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringStartsWith,
)
from pyspark.sql.types import DataType, LongType, StringType, StructType

#: Columns that are read of each table of the database (fixed names).
SCHEMAS = {
    "items": "itemID long, key string, itemTypeID long, dateModified string",
    "itemTypes": "itemTypeID long, typeName string",
    "itemData": "itemID long, fieldID long, valueID long",
    "itemDataValues": "valueID long, value string",
    "itemCreators": "itemID long, creatorID long, orderIndex long",
    "creators": "creatorID long, firstName string, lastName string",
    "itemAttachments": "itemID long, parentItemID long, linkMode long, contentType string, path string",
    "itemAnnotations": "itemID long, parentItemID long, type long, authorName string, text string, comment string, color string, pageLabel string, sortIndex string, position string, isExternal long",
    "itemNotes": "itemID long, parentItemID long, note string, title string",
}
TITLE, ABSTRACT, DATE = 1, 2, 6
CHILDREN = ("attachment", "note", "annotation")
ROWS_A_PART = 200_000
ROWS_A_BATCH = 8192


def find_database(explicit: str | None = None, environ: dict | None = None, home: Path | None = None) -> str:
    """The given path, or that of the environment (unless it is a placeholder), or the usual place."""
    env = (environ if environ is not None else os.environ).get("ZOTERO_DB_PATH", "")
    for path in (explicit, env if "${" not in env else None):
        if path:
            return path
    usual = (home or Path.home()) / "Zotero" / "zotero.sqlite"
    if not usual.exists():
        raise FileNotFoundError(f"no bibliographic database at {usual}")
    return str(usual)


class _Rows(InputPartition):
    """Rows from one rowid up to another, or to the end."""

    def __init__(self, first: int, stop: int | None) -> None:
        self.first, self.stop = first, stop


_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _Reader(DataSourceReader):
    """Filters that SQLite answers as Spark would are part of the scan; Spark applies the others."""

    def __init__(self, path: str, table: str, schema: StructType) -> None:
        self.path, self.table, self.schema = path, table, schema
        self.conditions: list[str] = []
        self.values: list = []

    def _kind(self, path: tuple[str, ...]) -> DataType | None:
        return {f.name: f.dataType for f in self.schema}.get(path[0]) if len(path) == 1 else None

    def _named(self, path: tuple[str, ...]) -> str:
        """A column as read() gives it, whatever type a row has there. Text is compared byte by byte, whatever the database says."""
        if isinstance(self._kind(path), StringType):
            return f'CAST("{path[0]}" AS TEXT) COLLATE BINARY'
        return f"CASE WHEN typeof(\"{path[0]}\") = 'integer' THEN \"{path[0]}\" END"

    def _column(self, path: tuple[str, ...], value) -> str | None:
        """The column, if a value of its type is compared with it."""
        kind = self._kind(path)
        fits = isinstance(kind, StringType) and isinstance(value, str) or isinstance(kind, LongType) and type(value) is int
        return self._named(path) if fits else None

    def _condition(self, f: Filter) -> tuple[str, list] | None:
        if isinstance(f, Not):
            inner = self._condition(f.child)
            return inner and (f"NOT ({inner[0]})", inner[1])
        if not isinstance(self._kind(f.attribute), (StringType, LongType)):
            return None
        name = self._named(f.attribute)
        if isinstance(f, IsNull):
            return f"{name} IS NULL", []
        if isinstance(f, IsNotNull):
            return f"{name} IS NOT NULL", []
        if isinstance(f, In):
            columns = {self._column(f.attribute, v) for v in f.value}
            return (f"{columns.pop()} IN ({', '.join('?' * len(f.value))})", list(f.value)) if len(columns) == 1 and None not in columns else None
        column = self._column(f.attribute, f.value)
        if column is None:
            return None
        if type(f) in _COMPARED:
            return f"{column} {_COMPARED[type(f)]} ?", [f.value]
        if isinstance(f, EqualNullSafe):
            return f"{column} IS ?", [f.value]
        if isinstance(f, StringContains):
            return f"instr({column}, ?) > 0", [f.value]
        if isinstance(f, StringStartsWith):
            return f"substr({column}, 1, length(?)) = ?", [f.value, f.value]
        return None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            found = self._condition(f)
            if found is None:
                yield f
            else:
                self.conditions.append(found[0])
                self.values += found[1]

    def statement(self, columns: str, *more: str) -> str:
        held = " AND ".join([*self.conditions, *more])
        return f'SELECT {columns} FROM "{self.table}"' + (f" WHERE {held}" if held else "")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        """Equal numbers of rows that pass the filters, however their ids are spread."""
        db = self._open()
        try:
            numbered = self.statement("rowid AS id, row_number() OVER (ORDER BY rowid) - 1 AS nth")
            firsts = [r[0] for r in db.execute(f"SELECT id FROM ({numbered}) WHERE nth % {ROWS_A_PART} = 0 ORDER BY id", self.values)]
        finally:
            db.close()
        return [_Rows(a, b) for a, b in zip(firsts, [*firsts[1:], None], strict=False)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        db = self._open()
        db.text_factory = lambda raw: raw.decode("utf-8", "replace")
        names = ", ".join(f'"{c}"' for c in self.schema.names)
        bounds, values = (["rowid >= ?", "rowid < ?"], [partition.first, partition.stop]) if partition.stop is not None else (["rowid >= ?"], [partition.first])
        try:
            rows = db.execute(self.statement(names, *bounds), [*self.values, *values])
            while part := rows.fetchmany(ROWS_A_BATCH):
                yield pa.RecordBatch.from_arrays([_array(c, f.dataType) for c, f in zip(zip(*part, strict=True), self.schema, strict=True)], self.schema.names)
        finally:
            db.close()


def _array(values: tuple, kind: DataType) -> pa.Array:
    """A column of what SQLite holds, which may be of any type in any row: numbers as text in a text column, and null for what is no number in a column of numbers."""
    if isinstance(kind, StringType):
        return pa.array([v if v is None or isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in values], pa.string())
    return pa.array([v if isinstance(v, int) else None for v in values], pa.int64())


class SqliteTable(DataSource):
    """format("sqlite_table"), options path and table; read-only, in Arrow batches, split by numbers of rows."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema)


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    return {t: spark.read.format("sqlite_table").option("path", path).option("table", t).load() for t in SCHEMAS}


def authors(creators: DataFrame) -> DataFrame:
    """itemID, authors from (itemID, orderIndex, firstName, lastName): "Last, First", or the last name alone; a first name alone is left out."""
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    name = F.when(some("lastName") & some("firstName"), F.concat_ws(", ", "lastName", "firstName")).when(some("lastName"), F.col("lastName"))
    return creators.select("itemID", "orderIndex", name.alias("name")).groupBy("itemID").agg(F.expr("listagg(name, '; ') WITHIN GROUP (ORDER BY orderIndex)").alias("authors"))


#: Attribute rows that one task sorts by item.
PIVOTED_A_PART = 250_000


def pivoted(item_data: DataFrame, values: DataFrame) -> DataFrame:
    """Attribute rows to one row for each item: title, abstract_note, date. The largest string is sought by sorting, so rows are counted, and
    dealt by item into parts of PIVOTED_A_PART before; a file's split holds as many as its compression allows. Values are never broadcast:
    a small file of them may be large in memory."""
    data = item_data.where(F.col("fieldID").isin(TITLE, ABSTRACT, DATE))
    rows = data.join(values.hint("merge"), "valueID").select("itemID", "fieldID", "value")
    dealt = rows.repartition(max(1, -(-data.count() // PIVOTED_A_PART)), "itemID")
    return dealt.groupBy("itemID").agg(*(F.max(F.when(F.col("fieldID") == k, F.col("value"))).alias(n) for k, n in ((TITLE, "title"), (ABSTRACT, "abstract_note"), (DATE, "date"))))


def items(t: dict[str, DataFrame]) -> DataFrame:
    """item_id, key, title, abstract_note, year, authors, date_modified of items that are no children of others."""
    own = t["items"].join(t["itemTypes"], "itemTypeID").where(~F.col("typeName").isin(*CHILDREN))
    people = authors(t["itemCreators"].join(t["creators"], "creatorID"))
    rows = own.join(pivoted(t["itemData"], t["itemDataValues"]), "itemID", "left").join(people, "itemID", "left")
    return rows.select(F.col("itemID").alias("item_id"), "key", "title", "abstract_note", F.substring("date", 1, 4).alias("year"), "authors", F.col("dateModified").alias("date_modified"))


def _with_parent(children: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """With the keys of a child and of its parent; children without a parent are left out."""
    key = t["items"].select("itemID", "key")
    parent = items(t).select(F.col("item_id").alias("parentItemID"), F.col("key").alias("parent_key"))
    return children.join(key, "itemID").join(parent, "parentItemID")


def attachments(t: dict[str, DataFrame], database: str, existing: DataFrame | None = None, mime_types: tuple[str, ...] = ("application/pdf",)) -> DataFrame:
    """PDF attachments with their resolved paths; with a listing (path), only those that exist."""
    rows = _with_parent(t["itemAttachments"].where(F.col("contentType").isin(*mime_types) & F.col("path").isNotNull()), t)
    base, home = str(Path(database).parent), str(Path.home())
    path = F.when(F.col("path").startswith("storage:"), F.concat_ws("/", F.lit(base), F.lit("storage"), "key", F.expr("substring(path, 9)"))).when(F.col("path").startswith("~/"), F.concat(F.lit(home), F.expr("substring(path, 2)"))).otherwise(F.col("path"))
    rows = rows.select("key", "parent_key", F.col("contentType").alias("mime_type"), path.alias("file_path"), F.col("itemID").alias("item_id"), F.col("linkMode").alias("link_mode"))
    return rows if existing is None else rows.join(existing.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")


def annotations(t: dict[str, DataFrame]) -> DataFrame:
    """Annotations with the key of the attachment they are on and of that one's item."""
    on = t["itemAttachments"].select(F.col("itemID").alias("parentItemID"), F.col("parentItemID").alias("ownerID"))
    key = t["items"].select("itemID", "key")
    rows = t["itemAnnotations"].join(key, "itemID").join(on, "parentItemID", "left").join(key.select(F.col("itemID").alias("parentItemID"), F.col("key").alias("attachment_key")), "parentItemID", "left")
    owner = items(t).select(F.col("item_id").alias("ownerID"), F.col("key").alias("parent_key"))
    return rows.join(owner, "ownerID").select("key", "parent_key", "attachment_key", "type", "authorName", "text", "comment", "color", "pageLabel", "sortIndex", "position", "isExternal")


def notes(t: dict[str, DataFrame]) -> DataFrame:
    return _with_parent(t["itemNotes"], t).select("key", "parent_key", "title", "note")


def resolved_path(kind, file_path, uri):
    """Local path of a file column triple; null for other storage or none."""
    return F.when(kind == "local", F.coalesce(F.nullif(file_path, F.lit("")), F.nullif(uri, F.lit(""))))
