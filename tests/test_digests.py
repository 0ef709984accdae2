"""Trees of digests against a whole join."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import digests, sync


def states(seed, n, changed, value=lambda r: r.choice(["x", "y", "", None])):
    rng = random.Random(seed)
    old = {i: (value(rng), value(rng)) for i in range(n)}
    new = {i: tuple(v or None for v in p) for i, p in old.items()}
    for i in rng.sample(range(n), changed):
        new[i] = ("new", new[i][1])
    for i in rng.sample(range(n), changed // 2):
        new.pop(i, None)
    return old, new | {n + i: ("a", None) for i in range(changed // 3)}


def stored(spark, tmp_path, name, rows, incoming, **options):
    df = spark.createDataFrame([(k, *v) for k, v in rows], "id long, a string, b string")
    return df, digests.snapshot(df, ["id"], ["a", "b"], f"file://{tmp_path}/{name}", F.coalesce("a", F.lit("none")), incoming, **options)


@pytest.mark.parametrize(("n", "changed", "bits"), [(200, 0, 8), (200, 9, 8), (60, 60, 4), (40, 6, 0), (0, 0, 8)])
def test_same_as_a_whole_join(spark, tmp_path, n, changed, bits):
    old, new = states(n + changed, n, changed)
    a, was = stored(spark, tmp_path, "old", old.items(), False, bits=bits)
    b, now = stored(spark, tmp_path, "new", new.items(), True, bits=bits)
    whole = sync.diff(a, b, ["id"], ["a", "b"])
    found, leaves = digests.changes(was, now)
    pick = lambda df: sorted((r["id"], r["outcome"]) for r in df.where("outcome <> 'unchanged'").collect())
    assert pick(found) == pick(whole)
    name = F.coalesce("new_a", F.lit("none"))
    key = lambda df: sorted(map(tuple, df.select("artifact", "added", "updated", "unchanged", "changed").collect()))
    assert key(digests.counts(was, now, name)) == key(sync.counts(whole, name))
    assert bool(leaves) == bool(changed)


def test_few_changes_read_few_leaves(spark, tmp_path):
    rows = {i: (f"v{i}", None) for i in range(3000)}
    _, was = stored(spark, tmp_path, "old", rows.items(), False)
    _, now = stored(spark, tmp_path, "new", (rows | {17: ("other", None), 2500: ("other", None)}).items(), True)
    found, leaves = digests.changes(was, now)
    assert len(leaves) <= 2 and found.count() < 60
    assert sorted(r["id"] for r in found.where("outcome = 'updated'").collect()) == [17, 2500]
    plan = was.leaves(leaves)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_leaf" in plan or "PartitionFilters: [_leaf" in plan


def test_values_that_move_between_columns_are_changes(spark, tmp_path):
    _, was = stored(spark, tmp_path, "old", [(1, ("x", None)), (2, ("", "y"))], False)
    _, now = stored(spark, tmp_path, "new", [(1, (None, "x")), (2, (None, "y"))], True)
    found, _ = digests.changes(was, now)
    assert {r["id"]: r["outcome"] for r in found.collect()}.get(1) == "updated"
    assert {r["id"]: r["outcome"] for r in found.collect()}.get(2, "unchanged") == "unchanged"
