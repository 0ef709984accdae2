"""Commits, conflicts, changes merged on reading, and what else changes rows of the queue."""

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_library import job, legacy

from lectern.operators import jobs as J
from lectern.plans import migration
from lectern.plans.store import Conflict, Store

NOW = datetime(2024, 5, 1, 12)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/lib", buckets=4)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, v long")


def held(store, name="t"):
    return {r["id"]: r["v"] for r in store.read(name).collect()}


def test_changes_take_the_place_of_rows(spark, store):
    store.write("t", spark.range(50).select("id", F.col("id").alias("v")), key=["id"])
    before = len(store._latest()[1]["t"]["parts"])
    store.merge("t", rows(spark, (3, 30), (100, 1)), rows(spark, (5, 0)))
    store.merge("t", rows(spark, (5, 55), (3, 31)), rows(spark, (7, 0), (5, 0)))  # a row counts more than its deletion
    want = {i: i for i in range(50) if i != 7} | {3: 31, 5: 55, 100: 1}
    parts = store._latest()[1]["t"]["parts"]
    assert held(store) == want and len(parts) == before + 2 and sum(p["changes"] for p in parts) == 2
    written = sum(spark.read.parquet(store._path(p["path"]).toString()).count() for p in parts if p["changes"])
    assert written == 7  # the changes and nothing else
    touched = {b for p in parts if p["changes"] for b in p["buckets"]}
    assert store.compact("t") == len(touched) and held(store) == want and store.compact("t") == 0
    assert not any(p["changes"] for p in store._latest()[1]["t"]["parts"])


def test_new_columns_and_rows_without_a_key(spark, store):
    store.write("t", rows(spark, (1, 1), (None, 2)), key=["id"])
    store.merge("t", spark.createDataFrame([(1, "x"), (None, "y")], "id long, w string"))
    assert sorted(map(str, (tuple(r) for r in store.read("t").collect()))) == sorted(map(str, [(None, 2, None), (1, None, "x"), (None, None, "y")]))


def test_writes_after_vacuum_are_read(spark, store):
    for v in range(5):
        store.write("t", rows(spark, (1, v)))
    assert store.vacuum(keep=2) == 3
    store.write("t", rows(spark, (1, 99)))
    assert held(store) == {1: 99} and store.vacuum(keep=1) == 2 and held(store) == {1: 99}


def test_an_older_state_can_be_read(spark, store):
    first = store.write("t", rows(spark, (1, 1)), key=["id"])
    store.merge("t", rows(spark, (1, 2)))
    assert store.read("t", first).first()["v"] == 1 and held(store) == {1: 2}


def test_a_writer_that_read_an_old_state_is_refused(spark, store):
    store.write("t", rows(spark, (1, 1)), key=["id"])
    store.write("u", rows(spark, (1, 1)), key=["id"])
    one, two, three = store.transaction(), store.transaction(), store.transaction()
    one.merge("t", one.read("t").withColumn("v", F.lit(10).cast("long")))
    two.merge("t", two.read("t").withColumn("v", F.lit(20).cast("long")))
    two.write("u", rows(spark, (9, 9)))
    three.merge("u", three.read("u").withColumn("v", F.lit(3).cast("long")))
    one.commit()
    with pytest.raises(Conflict, match="t changed"):
        two.commit()
    three.commit()  # another table
    assert held(store) == {1: 10} and held(store, "u") == {1: 3}  # nothing of the refused commit is seen


def test_blind_changes_do_not_conflict(spark, store):
    store.write("t", rows(spark, (1, 1)), key=["id"])
    late = store.transaction()
    late.merge("t", rows(spark, (2, 2)))
    store.merge("t", rows(spark, (3, 3)))
    late.commit()
    assert held(store) == {1: 1, 2: 2, 3: 3}


def test_an_entry_is_created_once(store):
    entry = {"tables": {}, "changed": []}
    won = []
    threads = [threading.Thread(target=lambda: won.append(store._create(1, entry))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 5 + [True] and store._numbers() == [1]


def test_two_claimers_never_get_one_job(spark, store):
    table = job(spark, rows=[{"id": f"j{i}", "entity_id": i} for i in range(6)])
    store.write("jobs", table)
    policy = J.Policy(batch_size=2)

    def claim(worker):
        store.update(lambda t: t.merge("jobs", J.claim(t.read("jobs"), NOW, worker, policy, changed=True)))

    threads = [threading.Thread(target=claim, args=(f"w{i}",)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    owners = [r["claimed_by"] for r in store.read("jobs").where("status = 'claimed'").collect()]
    assert sorted(owners) == ["w0", "w0", "w1", "w1", "w2", "w2"]
    assert all(r["attempts"] == 1 for r in store.read("jobs").collect())


def test_an_interrupted_migration_shows_the_old_state(spark, store, monkeypatch):
    docs, files = legacy(spark)
    store.commit(documents=docs, document_files=files)
    before = sorted(map(str, store.read("documents").collect())), sorted(map(str, store.read("document_files").collect()))
    monkeypatch.setattr(store, "_create", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        migration.migrated(store, NOW, J.Policy())
    monkeypatch.undo()
    assert before == (sorted(map(str, store.read("documents").collect())), sorted(map(str, store.read("document_files").collect()))) and not store.exists("jobs")
    migration.migrated(store, NOW, J.Policy())
    assert store.read("jobs").count() > 0 and store.read("documents").where("kind = 'pdf_chunk'").count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_a_stale_completion_beside_a_valid_one(spark, order):
    claimed = J.claim(job(spark, rows=[{"id": "a"}]), NOW, "w")
    token = claimed.first()["claim_token"]
    told = spark.createDataFrame([("a", "stale", "permanent_validation", "x"), ("a", token, None, None), (None, None, None, None)][::order], "id string, token string, error_class string, error_message string")
    for table in (J.complete(claimed, told, NOW), J.complete(claimed, told, NOW, changed=True)):
        assert [(r["status"], r["last_error"]) for r in table.collect()] == [("succeeded", None)]
    assert J.complete(claimed, told.where("token = 'stale'"), NOW).first()["status"] == "claimed"
    assert J.complete(claimed, told.where("token = 'stale'"), NOW, changed=True).count() == 0


def test_changed_rows_are_those_that_change(spark):
    table = job(spark, rows=[{"id": "a", "status": "dead"}, {"id": "b", "status": "claimed", "claim_expires_at": NOW - timedelta(days=1)}, {"id": "c"}])
    pairs = [
        (lambda **k: J.claim(table, NOW, "w", **k), {"c"}), (lambda **k: J.reclaim_expired(table, NOW, **k), {"b"}), (lambda **k: J.requeue_dead(table, NOW, 5, **k), {"a"}), (lambda **k: J.requeue_dead(table, NOW, **k), {"a"}),
        (lambda **k: J.cancel(table, NOW, with_claimed=True, **k), {"b", "c"}), (lambda **k: J.renew(table, NOW, "b", "other", **k), set()),
    ]
    for step, ids in pairs:
        whole, changed = {r["id"]: r for r in step().collect()}, {r["id"]: r for r in step(changed=True).collect()}
        assert set(changed) == ids and all(whole[i] == changed[i] for i in ids) and set(whole) == {"a", "b", "c"}


def test_a_long_top_of_dead_jobs_is_no_single_task(spark, monkeypatch):
    table = job(spark, rows=[{"id": f"{i:03}", "status": "dead", "updated_at": NOW + timedelta(seconds=i // 7)} for i in range(40)])
    want = {n: {r["id"] for r in J.requeue_dead(table, NOW, n).where("status = 'retry'").collect()} for n in (1, 6, 7, 20, 40, 50)}
    monkeypatch.setattr(J, "SENT", 0)
    for n, ids in want.items():
        assert {r["id"] for r in J.requeue_dead(table, NOW, n).where("status = 'retry'").collect()} == ids and len(ids) == min(n, 40)
