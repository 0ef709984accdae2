"""Leases of claimed jobs as a stream keyed by shards of jobs, with a timer at the first end in each, and streams of attempts beside their claims.

Events of a job (claims, renewals, completions) come with a time. A claim starts a lease and a timer for its end; a renewal by the
claim's token moves both; a completion by the token ends them. A lease that nobody ended by its time goes back to retry, or to
dead at the limit of attempts, as reclaim_expired() would do at that very time. Within a micro-batch the events of a job are taken in
the order of time, and a lease that ran out before the next event has run out, so results do not depend on how events are cut
into batches as long as none is later than the watermark allows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from lectern.operators.jobs import Policy

#: Columns of an event: kind is claim, renew or complete; attempts and max_attempts count for claims, error_class (null for success) for completions.
EVENT = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("token", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("max_attempts", T.IntegerType()), T.StructField("error_class", T.StringType())])
#: What leaves: the job's new status, when, and by whose token; `stale` for a renewal or a completion that is not the lease's.
TRANSITION = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("status", T.StringType()), T.StructField("token", T.StringType()), T.StructField("reason", T.StringType())])
#: Leases of a shard, column by column.
_LEASES = T.StructType([T.StructField("jobs", T.ArrayType(T.StringType())), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("attempts", T.ArrayType(T.IntegerType())), T.StructField("most", T.ArrayType(T.IntegerType()))])
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: As TRANSITION, with the time in milliseconds.
_TOLD = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("ms", T.LongType()), *TRANSITION.fields[2:]])
#: What is read of an event, with its time in milliseconds.
_READ = ("job_id", "ms", "kind", "token", "attempts", "max_attempts", "error_class")
#: Jobs are dealt into so many shards by a hash; a task holds the events of one shard and batch at a time.
SHARDS = 4096


class Leases(StatefulProcessor):
    """Leases of one shard of jobs: (token, end in milliseconds, attempts, limit of attempts) by job, and one timer at the first end. A
    state and a timer for each job would mean several calls from Python to Spark for each, which take far longer than the job does."""

    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("leases", _LEASES)

    def _again(self, attempts: int, most: int | None) -> str:
        return "retry" if attempts < min(self.policy.max_attempts, most if most is not None else self.policy.max_attempts) else "dead"

    def _leases(self) -> dict[str, tuple]:
        if not self.held.exists():
            return {}
        jobs, *columns = self.held.get()
        return dict(zip(jobs, zip(*columns)))

    def _keep(self, leases: dict[str, tuple], timer: int | None) -> None:
        """Stores what is left, and moves the timer, which stood at a time or not at all, to the first end."""
        first = min((lease[1] for lease in leases.values()), default=None)
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if leases:
            self.held.update(([*leases], *map(list, zip(*leases.values()))))
        elif timer is not None:
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        leases = self._leases()
        timer = min((lease[1] for lease in leases.values()), default=None)
        length = self.policy.lease_seconds * 1000
        out = []
        # of events at one time a completion comes first, so that a worker may claim at once what another has left
        rank = {"complete": 0, "renew": 1, "claim": 2}
        # a missing number comes as NaN, a missing string as None
        columns = [c for part in rows for c in zip(*(part[name].tolist() for name in _READ))]
        for job, now, kind, token, attempts, most, error in sorted(columns, key=lambda e: (e[1], rank.get(e[2], 3), e[3] or "")):
            lease = leases.get(job)
            if lease is not None and lease[1] <= now:
                out.append(self._expired(job, lease))
                del leases[job]
                lease = None
            own = lease is not None and token is not None and lease[0] == token
            if kind == "claim":
                if lease is None:
                    leases[job] = (token, now + length, 0 if pd.isna(attempts) else int(attempts), None if pd.isna(most) else int(most))
                    out.append((job, now, "claimed", token, None))
                else:
                    out.append((job, now, "stale", token, "claimed by another"))
            elif not own:
                out.append((job, now, "stale", token, kind))
            elif kind == "renew":
                leases[job] = (lease[0], now + length, *lease[2:])
            else:
                status = "succeeded" if error is None else "dead" if error.startswith("permanent_") else self._again(*lease[2:])
                out.append((job, now, status, token, error))
                del leases[job]
        self._keep(leases, timer)
        yield from _told(out)

    def _expired(self, job: str, lease: tuple) -> tuple:
        return job, lease[1], self._again(*lease[2:]), lease[0], "lease expired"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed; the next timer is behind it."""
        leases, passed = self._leases(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        gone = {job: lease for job, lease in leases.items() if lease[1] <= passed}
        if gone:
            left = {job: lease for job, lease in leases.items() if job not in gone}
            if left:
                self._keep(left, None)
            else:
                self.held.clear()
            yield from _told([self._expired(job, lease) for job, lease in gone.items()])

    def close(self) -> None:
        pass


def _told(rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=_TOLD.names)


def transitions(events: DataFrame, policy: Policy = Policy(), late: str = "1 minute", shards: int = SHARDS) -> DataFrame:
    """TRANSITION rows of a stream of EVENT rows. Timers fire as the watermark, `late` behind the latest event, passes them. The number of shards is fixed with a stream's checkpoint."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    timed = events.where("job_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    sharded = timed.withColumn("shard", F.pmod(F.xxhash64("job_id"), F.lit(shards))).select("shard", "at", *_READ)
    told = sharded.groupBy("shard").transformWithStateInPandas(Leases(policy), _TOLD, "Append", "EventTime")
    return told.select("job_id", F.timestamp_millis("ms").alias("at"), *TRANSITION.names[2:])


def attempts_with_claims(claims: DataFrame, attempts: DataFrame, within: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Two streams (job_id, token, at): each attempt beside the claim that it belongs to, if it comes at most so long after it. State of either side is dropped once the watermarks have passed the time in which it could be joined."""
    c = claims.select(F.col("job_id").alias("c_job"), F.col("token").alias("c_token"), F.col("at").alias("claimed_at")).withWatermark("claimed_at", late)
    a = attempts.withWatermark("at", late)
    near = F.expr(f"job_id = c_job AND token = c_token AND at >= claimed_at AND at <= claimed_at + INTERVAL {within}")
    return a.join(c, near).select("job_id", "token", "claimed_at", "at", F.timestamp_diff("SECOND", "claimed_at", "at").alias("seconds"))


def sessions(events: DataFrame, by: str, time: str = "at", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by `by` in sessions: runs without a pause of `gap`. On a stream a session leaves once the watermark has passed its end."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"), F.max(time).alias("last")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "last")


def collected(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All that an appending stream gives of what there is now; a batch that comes again replaces itself."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start().awaitTermination()
    kinds = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return stream.sparkSession.read.schema(kinds).parquet(out).drop("batch")
