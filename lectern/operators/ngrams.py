"""LIKE and ILIKE of a part of a text by an index of trigrams.

For each three characters in a row, lower-cased, the index lists the documents that hold them. Documents are taken in blocks as they
are read, so a list has a bounded length however many documents hold a trigram, and each task has whole lists of its own blocks: only
lists are shuffled, not a row for each trigram of each document. A list is sorted and stored as the
differences of neighbours in as few bytes as they need. A search reads the lists of the needle's trigrams, which are stored by
the trigram's hash, intersects them block by block, and holds the pattern itself against the documents that are left. A needle of
fewer than three characters between wildcards has no trigram: then all texts are read."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram, documents of a block, entries of lists after which a block ends early, and parts that lists are stored in.
SIZE = 3
IDS = 50_000
ENTRIES = 8_000_000
PARTS = 64


def grams_of(text: str) -> set[str]:
    """Distinct trigrams, lower-cased one character at a time, so that those of a part are among those of the whole."""
    low = "".join(c if len(c := x.lower()) == 1 else x for x in text)
    return {low[i : i + SIZE] for i in range(len(low) - SIZE + 1)}


def packed(ids: np.ndarray) -> bytes:
    """Sorted ids as differences: seven bits a byte, the last byte of each without its high bit."""
    gaps = np.diff(ids.astype(np.int64), prepend=0).astype(np.uint64)
    if len(gaps):  # the first id may be negative: its sign goes into its lowest bit
        head = int(ids[0])
        gaps[0] = np.uint64(head << 1 if head >= 0 else (-head << 1) - 1)
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        size += gaps >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(10):
        some = size > k
        place = (ends - size)[some] + k
        out[place] = ((gaps[some] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | ((size[some] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(a < 0x80)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate(([0], last[:-1] + 1))
    shift = (np.arange(len(a)) - np.repeat(first, last - first + 1)).astype(np.uint64) * np.uint64(7)
    gaps = np.add.reduceat((a & 0x7F).astype(np.uint64) << shift, first)
    head = int(gaps[0])
    gaps = gaps.astype(np.int64)  # differences may need all 64 bits, and add up to ids all the same
    gaps[0] = head >> 1 if not head & 1 else -(head >> 1) - 1
    return np.cumsum(gaps)


def _listed_rows(documents: Iterable[tuple[int, str]], most: int, block: int, entries: int) -> Iterator[pa.RecordBatch]:
    """Lists of (id, text), in blocks of at most `most` documents that end early with so many entries."""
    held: dict[str, array] = {}
    rows = size = 0

    def stored() -> Iterator[pa.RecordBatch]:
        names = list(held)
        for at in range(0, len(names), 4096):
            ids = [np.unique(np.frombuffer(held[g], np.int64)) for g in names[at : at + 4096]]
            yield pa.RecordBatch.from_pydict({"gram": pa.array(names[at : at + 4096], pa.string()), "block": pa.array([block] * len(ids), pa.int64()), "n": pa.array([len(x) for x in ids], pa.int32()), "ids": pa.array(map(packed, ids), pa.binary())})

    for i, text in documents:
        own = grams_of(text)
        for g in own:
            if g in held:
                held[g].append(i)
            else:
                held[g] = array("q", (i,))
        rows, size = rows + 1, size + len(own)
        if rows >= most or size >= entries:
            yield from stored()
            held.clear()
            block, rows, size = block + 1, 0, 0
    yield from stored()


def _listed(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield from _listed_rows(documents, most, TaskContext.get().partitionId() << 32, ENTRIES)

    return run


@dataclass
class Index:
    """Lists (gram, block, n, ids) under a path, of a table's id and text columns."""

    documents: DataFrame
    id_col: str
    text_col: str
    path: str

    @property
    def lists(self) -> DataFrame:
        return self.documents.sparkSession.read.schema("gram string, block long, n int, ids binary, part int").parquet(self.path)


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def build(documents: DataFrame, id_col: str, text_col: str, path: str, ids: int = IDS) -> Index:
    """Indexes every row with an id and a text. Rows that share an id are found together, and each is held against the pattern."""
    rows = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    lists = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_listed(ids), "gram string, block long, n int, ids binary")
    stored = lists.withColumn("part", _part(F.col("gram")))
    stored.repartition("part").write.partitionBy("part").parquet(path)
    return Index(documents, id_col, text_col, path)


def needles(pattern: str) -> set[str]:
    """Trigrams that every text has which is LIKE the pattern: of the runs between its wildcards."""
    runs, held, escaped = [], "", False
    for c in pattern:
        if escaped or c not in "%_\\":
            held, escaped = held + c, False
        elif c == "\\":
            escaped = True
        else:
            runs, held = [*runs, held], ""
    return {g for run in [*runs, held] for g in grams_of(run)}


def _intersected(wanted: int):
    def run(table: pa.Table) -> pa.Table:
        lists = sorted((unpacked(x) for x in table["ids"].to_pylist()), key=len)
        found = lists[0] if len(lists) == wanted else lists[0][:0]
        for x in lists[1:]:
            found = found[np.isin(found, x, assume_unique=True)]
        return pa.table({"id": pa.array(found, pa.int64())})

    return run


def candidates(index: Index, pattern: str) -> DataFrame | None:
    """Ids of documents that have all trigrams of a pattern; None if it has none."""
    wanted = sorted(needles(pattern))
    if not wanted:
        return None
    spark = index.documents.sparkSession
    parts = sorted({r["p"] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_part(F.col("gram")).alias("p")).collect()})
    lists = index.lists.where(F.col("part").isin(parts) & F.col("gram").isin(wanted))
    return lists.select("block", "ids").groupBy("block").applyInArrow(_intersected(len(wanted)), "id long")


def like(index: Index, pattern: str, ignore_case: bool = False) -> DataFrame:
    """The documents whose text is LIKE (or ILIKE) a pattern, with % and _ and a backslash before what is meant as such."""
    found, text = candidates(index, pattern), F.col(index.text_col)
    rows = index.documents if found is None else index.documents.join(found.withColumnRenamed("id", "_id"), F.col(index.id_col) == F.col("_id"), "left_semi")
    return rows.where(text.ilike(pattern) if ignore_case else text.like(pattern))
