"""Streams with state: leases and their timers, late rows, sessions and joins in several runs of one query."""

import random
from datetime import datetime, timedelta

import pytest

from lectern.operators.jobs import Policy
from lectern.streaming import leases, queue

START = datetime(2024, 5, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def replayed(events, policy, until):
    """What a list of events, in the order of time, does to leases."""
    out, held = [], {}

    def again(attempts, most):
        return "retry" if attempts < min(policy.max_attempts, most) else "dead"

    def expire(now):
        for job, (token, end, attempts, most) in sorted(held.items()):
            if end <= now:
                out.append((job, at(end), again(attempts, most), token))
                del held[job]

    rank = {"complete": 0, "renew": 1, "claim": 2}
    for job, t, kind, token, attempts, most, error in sorted(events, key=lambda e: (e[1], rank[e[2]], e[3])):
        expire(t)
        own = job in held and held[job][0] == token
        if kind == "claim" and job not in held:
            held[job] = (token, t + policy.lease_seconds, attempts, most)
            out.append((job, at(t), "claimed", token))
        elif kind == "renew" and own:
            held[job] = (token, t + policy.lease_seconds, *held[job][2:])
        elif kind == "complete" and own:
            _, _, a, m = held.pop(job)
            out.append((job, at(t), "succeeded" if error is None else "dead" if error.startswith("permanent") else again(a, m), token))
        else:
            out.append((job, at(t), "stale", token))
    expire(until)
    return sorted(out)


def drawn(seed, n=300):
    rng = random.Random(seed)
    events = []
    for _ in range(n):
        kind = rng.choice(["claim", "claim", "renew", "complete"])
        events.append((f"j{rng.randrange(12)}", rng.randrange(3000), kind, f"t{rng.randrange(3)}", rng.randrange(6), rng.randrange(1, 7), rng.choice([None, "retryable_io", "permanent_validation"]) if kind == "complete" else None))
    return events


def run(spark, tmp_path, parts, stream):
    """Writes one part after another, and lets the query go on from its checkpoint each time."""
    for i, (rows, schema) in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        out = leases.collected(stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part=*")), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return out.collect()


@pytest.mark.parametrize("cuts", [[], [700, 1500, 1501]])
def test_leases_do_not_depend_on_batches(spark, tmp_path, cuts):
    policy, events = Policy(lease_seconds=180), drawn(5)
    edges = [0, *cuts, 10**6]
    parts = [([(j, at(t), *rest) for j, t, *rest in events if a <= t < b], leases.EVENT) for a, b in zip(edges, edges[1:])]
    parts[-1][0].append(("end", at(20_000), "renew", "x", None, None, None))
    got = run(spark, tmp_path, parts, lambda s: leases.transitions(s, policy))
    assert sorted((r["job_id"], r["at"], r["status"], r["token"]) for r in got if r["job_id"] != "end") == replayed(events, policy, 19_000)


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    schema = "event_type string, ts timestamp, value double"
    one = [("a", at(0), 1.0), ("a", at(4 * 3600), 1.0)]
    two = [("a", at(60), 1.0), ("a", at(3 * 3600), 1.0), ("a", at(100 * 3600), 1.0)]  # the first is later than the watermark allows
    got = run(spark, tmp_path, [(one, schema), (two, schema)], lambda s: queue.tumbling_counts(s, late="2 hours"))
    assert sorted((r["window_start"], r["n"]) for r in got) == [(at(0), 1), (at(3 * 3600), 1), (at(4 * 3600), 1)]


def test_sessions_and_joins_over_several_runs(spark, tmp_path):
    events = [(u, at(t)) for u, ts in {1: [0, 200, 400, 1000, 5000], 2: [100, 900]}.items() for t in ts]
    schema = "user long, at timestamp"
    parts = [([e for e in events if e[1] < at(300)], schema), ([e for e in events if e[1] >= at(300)] + [(9, at(10**6))], schema)]
    got = run(spark, tmp_path / "s", parts, lambda s: leases.sessions(s, "user"))
    assert sorted((r["user"], r["session_start"], r["n"]) for r in got) == [(1, at(0), 3), (1, at(1000), 1), (1, at(5000), 1), (2, at(100), 1), (2, at(900), 1)]
    claims = spark.createDataFrame([("a", "t", at(0)), ("b", "t", at(0))], "job_id string, token string, at timestamp")
    tries = spark.createDataFrame([("a", "t", at(600)), ("a", "t", at(601)), ("b", "u", at(5)), ("b", "t", at(0)), ("b", "t", at(-1))], claims.schema)
    for name, rows in (("claims", claims), ("tries", tries)):
        rows.write.parquet(f"{tmp_path}/{name}")
    read = lambda n: spark.readStream.schema(claims.schema).parquet(f"{tmp_path}/{n}")
    got = leases.collected(leases.attempts_with_claims(read("claims"), read("tries")), f"{tmp_path}/joined", f"{tmp_path}/joining").collect()
    assert sorted((r["job_id"], r["seconds"]) for r in got) == [("a", 600), ("b", 0)]


@pytest.mark.parametrize("shards", [1, 3])
def test_jobs_share_states_and_timers(spark, tmp_path, shards):
    """A shard has one state row and one timer at most, however many leases it holds; ends in one shard come one after another, over several runs."""
    policy = Policy(lease_seconds=180, max_attempts=4)
    events = [(f"k{n}", n % 700, "claim", "t", n % 6, 5, None) for n in range(200)] + [(f"k{n}", n % 700 + 170, "renew", "t", 0, 0, None) for n in range(0, 200, 3)]
    events += [(f"k{n}", n % 700 + 300 - n % 2, "complete", "t", 0, 0, "permanent_x" if n % 4 else None) for n in range(0, 200, 6)]
    told = [(j, at(t), *rest) for j, t, *rest in events]
    told += [("lone", at(10), "claim", None, None, None, None), ("end", at(20_000), "renew", "x", None, None, None)]
    parts = [([e for e in told if a <= e[1] < b], leases.EVENT) for a, b in ((at(0), at(250)), (at(250), at(10**6)))]
    kept = []

    def stream(source):
        return leases.transitions(source, policy, shards=shards)

    for i in range(2):
        got = run(spark, tmp_path / str(i), parts[: i + 1], stream)
        kept.append(len(got))
    found = sorted((r["job_id"], r["at"], r["status"], r["token"]) for r in got if r["job_id"] not in ("end", "lone"))
    assert found == replayed(events, policy, 19_000) and kept[0] < kept[1]
    assert sorted((r["at"], r["status"], r["token"], r["reason"]) for r in got if r["job_id"] == "lone") == [(at(10), "claimed", None, None), (at(190), "retry", None, "lease expired")]
    states = spark.read.format("statestore").option("stateVarName", "leases").load(f"{tmp_path}/0/checkpoint")
    assert 0 < states.count() <= shards
