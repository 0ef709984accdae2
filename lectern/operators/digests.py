"""Change detection by a tree of digests: of two snapshots only the leaves that differ are read and joined.

A row belongs to the leaf that the first bits of its key's hash name. A leaf's digest is the number of its rows and two sums
of their hashes, so it does not depend on their order and is summed in parts; a node's digest is the sum of its children's. Rows
are stored by leaf. Two trees are compared from the root, and only below nodes that differ, so with few changes few rows
of the trees and few leaves are read. What is in equal leaves is unchanged; the others are joined as sync.diff() does."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import sync

#: Bits of a leaf, and of a step down the tree.
BITS, FAN = 8, 4
LEAF = "_leaf"


@dataclass
class Snapshot:
    """A stored state: rows by leaf, digests (level, node, n, one, two), and numbers of rows by leaf and artifact."""

    spark: SparkSession
    path: str
    keys: list[str]
    compared: list[str]
    bits: int
    schema: T.StructType

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    @property
    def tree(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tree")

    @property
    def sizes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sizes")

    def leaves(self, wanted: list[int]) -> DataFrame:
        return self.rows.where(F.col(LEAF).isin(wanted)).drop(LEAF)


def _hash(keys: list[str], values: list[Column], salt: int) -> Column:
    """Of a row. A null is no value, and values of different columns are never taken for each other."""
    parts = [x for c in [*(F.col(k) for k in keys), *values] for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))]
    return F.xxhash64(F.lit(salt), *parts).cast("decimal(38,0)")


def snapshot(rows: DataFrame, keys: list[str], compared: list[str], path: str, artifact: Column | None = None, incoming: bool = False, bits: int = BITS) -> Snapshot:
    """Stores a state under a path. Of rows with one key the last counts in what comes in; an empty stored value is none, as in sync.diff()."""
    spark = rows.sparkSession
    own = sync.last_of(rows, keys, compared) if incoming else rows.select(*keys, *compared)
    leaf = F.shiftrightunsigned(F.xxhash64(*(F.col(k).cast("string") for k in keys)), 64 - bits).cast("int") if bits else F.lit(0)
    # every leaf has a file of its own, or none
    own.withColumn(LEAF, leaf).repartition(LEAF).write.partitionBy(LEAF).parquet(f"{path}/rows")
    schema = T.StructType([*own.schema.fields, T.StructField(LEAF, T.IntegerType())])
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    values = [F.col(c) if incoming else F.nullif(F.col(c).cast("string"), F.lit("")) for c in compared]
    named = stored.withColumn("_artifact", F.lit("") if artifact is None else artifact)
    by_leaf = named.groupBy(LEAF, "_artifact").agg(F.count("*").alias("n"), F.sum(_hash(keys, values, 1)).alias("one"), F.sum(_hash(keys, values, 2)).alias("two"))
    by_leaf.write.parquet(f"{path}/sizes")
    sizes = spark.read.schema(by_leaf.schema).parquet(f"{path}/sizes")
    levels = sizes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits), F.lit(FAN)) if bits else F.array(F.lit(0))))
    node = F.expr(f"shiftright({LEAF}, {bits} - level)")
    levels.groupBy("level", node.alias("node")).agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).write.parquet(f"{path}/tree")
    return Snapshot(spark, path, keys, compared, bits, schema)


def differing(old: Snapshot, new: Snapshot) -> list[int]:
    """Leaves that differ, found from the root down: at each level only children of nodes that differ are looked at."""
    if (old.keys, old.compared, old.bits) != (new.keys, new.compared, new.bits):
        raise ValueError("snapshots of another shape")
    nodes = [0]
    for level in range(0, old.bits + 1, FAN):
        here = lambda s, n=tuple(nodes), at=level: s.tree.where((F.col("level") == at) & F.col("node").isin(*n)).select("node", F.struct("n", "one", "two").alias("digest"))
        both = here(old).withColumnRenamed("digest", "was").join(here(new), "node", "full_outer")
        found = sorted(r["node"] for r in both.where(~F.col("was").eqNullSafe(F.col("digest"))).select("node").collect())  # nodes of one level
        if not found or level == old.bits:
            return found
        nodes = [(n << FAN) + i for n in found for i in range(1 << FAN)]
    return nodes


def changes(old: Snapshot, new: Snapshot) -> tuple[DataFrame, list[int]]:
    """What sync.diff() says of the rows in leaves that differ, and these leaves; all other rows are unchanged."""
    leaves = differing(old, new)
    return sync.diff(old.leaves(leaves), new.leaves(leaves), old.keys, old.compared), leaves


def counts(old: Snapshot, new: Snapshot, artifact: Column) -> DataFrame:
    """As sync.counts(): rows of equal leaves are counted by what their snapshot says of them, and not read."""
    found, leaves = changes(old, new)
    part = sync.counts(found, artifact).where("artifact <> 'Total'").drop("changed")
    same = new.sizes.where(~F.col(LEAF).isin(leaves)).groupBy(F.col("_artifact").alias("artifact")).agg(F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("updated"), F.sum("n").alias("unchanged"))
    total = part.unionByName(same).rollup("artifact").agg(*(F.coalesce(F.sum(o), F.lit(0)).alias(o) for o in sync.OUTCOMES))
    return total.select(F.coalesce("artifact", F.lit("Total")).alias("artifact"), *sync.OUTCOMES, (F.col("added") + F.col("updated")).alias("changed"))
