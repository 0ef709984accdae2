"""Named tables in one folder: commits that are atomic over all tables, and writes in proportion to what changes.

A log holds one numbered entry for each commit, which says of every table what its parts are; the entry with the highest
number is the state of all tables. An entry is created under the number after the one that the writer has read, and only if no other
writer has created it meanwhile. If one has, and changed a table that this writer has read or replaces, the commit
fails with Conflict and nothing of it is seen; otherwise it is made again on top of the other.

A table with a key is merged on reading: a part holds whole rows, or changes (rows that take the place of those with their
key, or delete them), and later changes come first. Both are written by bucket of the key's hash, so compact() rewrites
the buckets that have changes and no others. Rows with a null in their key take nobody's place.

Creating an entry is atomic on a local file system (a hard link) and wherever a rename that does not overwrite is (HDFS).
Object stores need a file system with such a rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.schema import KEYS, TABLES, evolved

BUCKETS = 16
#: Columns that only the parts have: the bucket of a row, and whether a change deletes.
BUCKET, DELETED = "_bucket", "_deleted"
Result = TypeVar("Result")


class Conflict(RuntimeError):
    """Another writer has changed what this one has read."""


@dataclass
class Transaction:
    """What is read from one state of all tables, and what is to take its place. Parts are written at once, and seen after commit()."""

    store: Store
    number: int
    state: dict
    reads: set[str] = field(default_factory=set)
    staged: list[tuple[str, Callable[[dict | None], dict]]] = field(default_factory=list)
    replaced: set[str] = field(default_factory=set)

    def read(self, name: str) -> DataFrame:
        self.reads.add(name)
        return self.store._frame(name, self.state)

    def write(self, name: str, df: DataFrame, key: Iterable[str] | None = None) -> None:
        """The whole table anew. With a key (of a known table, its own), changes can be merged into it."""
        key = list(key) if key is not None else [c for c in KEYS.get(name, ()) if c in df.columns]
        part = self.store._part(name, df, key, False)
        self.replaced.add(name)
        self.staged.append((name, lambda _: {"key": key, "parts": [part]}))

    def merge(self, name: str, rows: DataFrame, deleted: DataFrame | None = None) -> None:
        """Rows that are added, or take the place of those with their key; and rows, of which the key counts, that go. Of several with one key the largest counts, and none of them that goes."""
        key = self._key(name)
        changes = rows.withColumn(DELETED, F.lit(False))
        if deleted is not None:
            changes = changes.unionByName(deleted.select(*key, F.lit(True).alias(DELETED)), allowMissingColumns=True)
        part = self.store._part(name, changes, key, True)
        self.staged.append((name, lambda old: {"key": key, "parts": [*(old or {"parts": []})["parts"], part]}))

    def _key(self, name: str) -> list[str]:
        key = self.state[name]["key"] if name in self.state else list(KEYS.get(name, ()))
        if not key:
            raise ValueError(f"{name} has no key")
        return key

    def compact(self, name: str, least: int = 1) -> int:
        """Rewrites the buckets that at least so many changes touch; their number."""
        table = self.state.get(name, {"parts": []})
        touched = [b for p in table["parts"] if p["changes"] for b in p["buckets"]]
        worth = sorted(b for b in set(touched) if touched.count(b) >= least)
        if not worth:
            return 0
        self.reads.add(name)
        part = self.store._part(name, self.store._frame(name, self.state, worth), table["key"], False)
        rest = [p | {"buckets": sorted(set(p["buckets"]) - set(worth))} for p in table["parts"]]
        kept = [part | {"buckets": worth}, *(p for p in rest if p["buckets"])]
        self.staged.append((name, lambda _: {"key": table["key"], "parts": kept}))
        return len(worth)

    def commit(self) -> int:
        """The number of the commit."""
        number, state = self.number, self.state
        while True:
            new = dict(state)
            for name, change in self.staged:
                new[name] = change(new.get(name))
            if self.store._create(number + 1, {"tables": new, "changed": sorted({n for n, _ in self.staged})}):
                return number + 1
            latest, state = self.store._latest()
            if not set(range(number + 1, latest + 1)) <= set(self.store._numbers()):
                raise Conflict(f"commits since {self.number} were forgotten meanwhile")
            others = {n for i in range(number + 1, latest + 1) for n in self.store._entry(i)["changed"]}
            if clash := others & (self.reads | self.replaced):
                raise Conflict(f"{', '.join(sorted(clash))} changed since commit {self.number}")
            number = latest


class Store:
    """Tables under one folder of any file system that Spark reaches, for any number of readers and writers."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("_log"))

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    # ---- the log ----

    def _numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path("_log")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _entry(self, number: int) -> dict:
        stream = self._fs.open(self._path("_log", f"{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _latest(self) -> tuple[int, dict]:
        found = self._numbers()
        return (found[-1], self._entry(found[-1])["tables"]) if found else (0, {})

    def _create(self, number: int, entry: dict) -> bool:
        """Whether the entry is created: not if there is one of its number."""
        draft, target = self._path("_log", f".{uuid.uuid4().hex}"), self._path("_log", f"{number:012d}.json")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        java = self.spark._jvm.java
        try:
            if self._fs.getScheme() == "file":
                java.nio.file.Files.createLink(java.nio.file.Path.of(target.toUri().getPath(), self._none()), java.nio.file.Path.of(draft.toUri().getPath(), self._none()))
            else:
                options = self.spark.sparkContext._gateway.new_array(self._jvm_rename(), 0)
                self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(draft, False)

    def _none(self):
        return self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0)

    def _jvm_rename(self):
        return getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")

    # ---- parts ----

    def _bucket(self, key: list[str]):
        return F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in key)), F.lit(self.buckets)).cast("int")

    def _part(self, name: str, df: DataFrame, key: list[str], changes: bool) -> dict:
        path = f"{name}/{uuid.uuid4().hex}"
        target = self._path(path)
        if not key:
            df.write.parquet(target.toString())
            return {"path": path, "changes": False, "buckets": [0], "schema": df.schema.json()}
        rows = df.withColumn(BUCKET, self._bucket(key))
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(target.toString())
        found = sorted(int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(target) if s.isDirectory() and "=" in s.getPath().getName())
        return {"path": path, "changes": changes, "buckets": found, "schema": rows.schema.json()}

    def _rows(self, part: dict, buckets: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(part["schema"]))
        df = self.spark.read.schema(schema).parquet(self._path(part["path"]).toString())
        if BUCKET not in schema.names:
            return df
        wanted = part["buckets"] if buckets is None else sorted(set(part["buckets"]) & set(buckets))
        return df.where(F.col(BUCKET).isin(wanted)).drop(BUCKET)

    def _frame(self, name: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """A table in a state of the log; of a known table that was never written, no rows."""
        if name not in state:
            if name not in TABLES:
                raise KeyError(name)
            return self.spark.createDataFrame([], TABLES[name])
        parts, key = state[name]["parts"], state[name]["key"]
        union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
        whole = [self._rows(p, buckets) for p in parts if not p["changes"]]
        changes = [self._rows(p, buckets).withColumn("_nth", F.lit(i)) for i, p in enumerate(parts) if p["changes"]]
        if changes:
            every = reduce(union, changes)
            columns = [c for c in every.columns if c not in key and c != "_nth"]
            named = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key))
            last = F.max_by(F.struct(*columns), F.struct("_nth", ~F.col(DELETED), F.struct(*columns)))
            latest = every.where(named).groupBy(*key).agg(last.alias("_last")).select(*key, "_last.*")
            own = latest.unionByName(every.where(~named).drop("_nth")).where(f"NOT {DELETED}").drop(DELETED)
            whole = [w.join(latest.select(*key), key, "left_anti") for w in whole] + [own]
        df = reduce(union, whole)
        return evolved(df, name) if name in TABLES else df

    # ---- tables ----

    def transaction(self) -> Transaction:
        number, state = self._latest()
        return Transaction(self, number, state)

    def update(self, change: Callable[[Transaction], Result], tries: int = 8) -> Result:
        """Carries out a change and commits it; after a conflict once more, on what the other writer left. The change's result."""
        for nth in range(tries):
            t = self.transaction()
            out = change(t)
            try:
                t.commit()
                return out
            except Conflict:
                if nth == tries - 1:
                    raise
        raise ValueError("no tries")

    def exists(self, name: str) -> bool:
        return name in self._latest()[1]

    def versions(self, name: str) -> list[int]:
        """Numbers of the commits that changed a table, oldest first."""
        return [n for n in self._numbers() if name in self._entry(n)["changed"]]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is, or as it was after a commit that vacuum() has left."""
        return self._frame(name, self._latest()[1] if version is None else self._entry(version)["tables"])

    def write(self, name: str, df: DataFrame, key: Iterable[str] | None = None) -> int:
        """One table anew; df may read the old one. Whatever else is written to it meanwhile is replaced too."""
        return self.commit(**{name: df}) if key is None else self._write({name: df}, key)

    def commit(self, **tables: DataFrame) -> int:
        """Several tables anew, all or none."""
        return self._write(tables, None)

    def _write(self, tables: dict[str, DataFrame], key: Iterable[str] | None) -> int:
        t = self.transaction()
        for name, df in tables.items():
            t.write(name, df, key)
        t.replaced.clear()
        return t.commit()

    def merge(self, name: str, rows: DataFrame, deleted: DataFrame | None = None) -> int:
        """Changes to one table that do not follow from what it held, so that other writers are no conflict."""
        t = self.transaction()
        t.merge(name, rows, deleted)
        return t.commit()

    def compact(self, name: str, least: int = 1) -> int:
        """Rewrites the buckets that at least so many changes touch; their number."""
        return self.update(lambda t: t.compact(name, least))

    def vacuum(self, keep: int = 2) -> int:
        """Forgets all but the newest commits and deletes the parts that only they had; the number of these. Parts that no entry names are left, as a writer may be about to commit them."""
        numbers = self._numbers()
        paths = lambda some: {p["path"] for n in some for t in self._entry(n)["tables"].values() for p in t["parts"]}
        old = numbers[: max(0, len(numbers) - max(1, keep))]
        unused = paths(old) - paths(numbers[len(old) :])
        for n in old:
            self._fs.delete(self._path("_log", f"{n:012d}.json"), False)
        for p in unused:
            self._fs.delete(self._path(p), True)
        return len(unused)
