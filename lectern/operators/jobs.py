"""The job queue as data: every transition takes the jobs table and gives the next one, or with `changed` only the rows that it changes, to be merged into a store. The clock is an argument."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    lease_seconds: int = 180
    batch_size: int = 32
    max_attempts: int = 5
    backoff_base_seconds: int = 5
    backoff_max_seconds: int = 900

    def settings(self) -> tuple[int, ...]:
        return self.lease_seconds, self.batch_size, self.max_attempts, self.backoff_base_seconds, self.backoff_max_seconds


def config_hash(*settings: Column) -> Column:
    """Tells configurations apart: the first sixteen digits of a hash of their settings."""
    return F.substring(F.sha2(F.concat_ws("|", *(s.cast("string") for s in settings)), 256), 1, 16)


def instant(now) -> Column:
    return F.date_trunc("second", F.lit(now).cast("timestamp"))


def later(at: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), at)


def backoff_seconds(attempts: Column, policy: Policy = Policy(), jitter_key: Column | None = None) -> Column:
    """Doubles with each attempt up to the limit; with a key, up to a quarter more, the same for the same key and attempt."""
    wait = F.least(F.lit(float(policy.backoff_max_seconds)), F.lit(float(policy.backoff_base_seconds)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1))).cast("long")
    if jitter_key is None:
        return wait
    most = F.greatest(F.lit(1), F.floor(wait / 4)).cast("long")
    return F.least(F.lit(policy.backoff_max_seconds).cast("long"), wait + F.pmod(F.xxhash64(jitter_key, attempts), most + 1))


def _limit(policy: Policy) -> Column:
    return F.least(F.col("max_attempts"), F.lit(policy.max_attempts))


def new_jobs(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Candidates whose dedupe_key is new, once each: what an insert that ignores conflicts would add."""
    return candidates.dropDuplicates(["dedupe_key"]).join(jobs.select("dedupe_key"), "dedupe_key", "left_anti").select(candidates.columns)


def queued(candidates: DataFrame, now, policy: Policy = Policy()) -> DataFrame:
    """Candidates as queued jobs, whose id is their dedupe_key."""
    stamp = {"id": F.col("dedupe_key"), "status": F.lit("queued"), "priority": F.lit(100), "available_at": instant(now), "attempts": F.lit(0), "max_attempts": F.lit(policy.max_attempts), "created_at": instant(now), "updated_at": instant(now)}
    return candidates.withColumns(stamp)


def claimable(jobs: DataFrame, now, policy: Policy = Policy(), queue: str | None = None) -> DataFrame:
    ready = jobs.where(F.col("status").isin("queued", "retry") & (F.col("available_at") <= instant(now)) & (F.col("attempts") < _limit(policy)))
    ready = ready.where(F.col("queue_name") == queue) if queue else ready
    return ready.orderBy("priority", "created_at", "id").limit(policy.batch_size)


def claim(jobs: DataFrame, now, worker: str, policy: Policy = Policy(), queue: str | None = None, changed: bool = False) -> DataFrame:
    """The jobs table after a worker claimed its batch (at most batch_size rows, which every task can hold)."""
    top = claimable(jobs, now, policy, queue)
    rows = top.withColumn("taken", F.lit(True)) if changed else jobs.join(F.broadcast(top.select("id", F.lit(True).alias("taken"))), "id", "left")
    token = F.sha2(F.concat_ws("|", "id", F.lit(worker), F.col("attempts") + 1), 256)
    return _updated(rows, F.coalesce("taken", F.lit(False)), now, status=F.lit("claimed"), claimed_by=F.lit(worker), claim_token=token, claim_expires_at=later(instant(now), F.lit(policy.lease_seconds)), attempts=F.col("attempts") + 1).select(jobs.columns)


def _updated(rows: DataFrame, when: Column, now, only: bool = False, **columns: Column) -> DataFrame:
    columns.setdefault("updated_at", instant(now))
    rows = rows.where(when) if only else rows
    return rows.select(*(F.when(when, columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def renew(jobs: DataFrame, now, job_id: str, token: str, policy: Policy = Policy(), changed: bool = False) -> DataFrame:
    own = (F.col("id") == job_id) & (F.col("status") == "claimed") & F.coalesce(F.col("claim_token") == token, F.lit(False))
    return _updated(jobs, own, now, changed, claim_expires_at=later(instant(now), F.lit(policy.lease_seconds)))


def reclaim_expired(jobs: DataFrame, now, policy: Policy = Policy(), changed: bool = False) -> DataFrame:
    """Claims whose lease ran out go back to retry, or to dead at the limit of attempts."""
    expired = (F.col("status") == "claimed") & F.coalesce(F.col("claim_expires_at") <= instant(now), F.lit(False))
    spent = F.col("attempts") >= _limit(policy)
    none = F.lit(None).cast("string")
    return _updated(jobs, expired, now, changed, status=F.when(spent, F.lit("dead")).otherwise(F.lit("retry")), claimed_by=none, claim_token=none, claim_expires_at=F.lit(None).cast("timestamp"))


def complete(jobs: DataFrame, completions: DataFrame, now, policy: Policy = Policy(), changed: bool = False) -> DataFrame:
    """Applies completions (id, token, error_class: null for success, error_message). One with a stale token leaves its job alone, whatever else comes with it; of several with the same token a success counts, else the first by class and message."""
    told = completions.where("id IS NOT NULL AND token IS NOT NULL").groupBy("id", F.col("token").alias("claim_token")).agg(F.min(F.struct("error_class", "error_message")).alias("told"))
    rows = jobs.join(told.select("id", "claim_token", "told.*", F.lit(True).alias("told")), ["id", "claim_token"], "inner" if changed else "left")
    own = (F.col("status") == "claimed") & F.coalesce("told", F.lit(False))
    again = ~F.col("error_class").startswith("permanent_") & (F.col("attempts") < _limit(policy))
    status = F.when(F.col("error_class").isNull(), F.lit("succeeded")).when(again, F.lit("retry")).otherwise(F.lit("dead"))
    next_at = F.when(F.col("error_class").isNotNull() & again, later(instant(now), backoff_seconds(F.col("attempts"), policy, F.col("id"))))
    none = F.lit(None).cast("string")
    out = _updated(rows, own, now, changed, status=status, available_at=F.coalesce(next_at, F.col("available_at")), last_error=F.coalesce("error_message", "last_error"), claimed_by=none, claim_token=none, claim_expires_at=F.lit(None).cast("timestamp"))
    return out.select(jobs.columns)


def attempt_outcomes(jobs: DataFrame, completions: DataFrame) -> DataFrame:
    """What each completion's attempt ends as: succeeded, retryable_fail, permanent_fail, or retryable_fail with stale_claim."""
    told = completions.select("id", F.col("token").alias("told_token"), "error_class")
    rows = told.join(jobs.select("id", "status", "claim_token"), "id")
    own = (F.col("status") == "claimed") & F.coalesce(F.col("claim_token") == F.col("told_token"), F.lit(False))
    outcome = F.when(~own, F.lit("retryable_fail")).when(F.col("error_class").isNull(), F.lit("succeeded")).when(F.col("error_class").startswith("permanent_"), F.lit("permanent_fail")).otherwise(F.lit("retryable_fail"))
    return rows.select("id", outcome.alias("outcome"), F.when(~own, F.lit("stale_claim")).otherwise(F.col("error_class")).alias("error_class"))


#: Rows of a top-k that are sent to every task; a longer one is joined.
SENT = 10_000


def requeue_dead(jobs: DataFrame, now, limit: int | None = None, reset_attempts: bool = False, queue: str | None = None, changed: bool = False) -> DataFrame:
    """Dead jobs, or the `limit` most recently updated ones, go to retry; without a reset, one that used up its attempts stays unclaimable."""
    wanted = F.col("status") == "dead"
    wanted = wanted & (F.col("queue_name") == queue) if queue else wanted
    new = {"status": F.lit("retry"), "available_at": instant(now)} | ({"attempts": F.lit(0)} if reset_attempts else {})
    if limit is None:
        return _updated(jobs, wanted, now, changed, **new)
    top = _newest(jobs.where(wanted).select("id", "updated_at"), limit).select("id", F.lit(True).alias("taken"))
    rows = jobs.join(F.broadcast(top) if limit <= SENT else top, "id", "inner" if changed else "left")
    return _updated(rows, F.coalesce("taken", F.lit(False)), now, **new).select(jobs.columns)


def _newest(rows: DataFrame, limit: int) -> DataFrame:
    """The `limit` most recently updated rows, ties by id: a top-k, or for a long one those after the last second that does not fit and the first ids of that second."""
    if limit <= SENT:
        return rows.orderBy(F.desc("updated_at"), "id").limit(limit)
    seconds = rows.groupBy("updated_at").agg(F.count("*").alias("n"))
    so_far = seconds.withColumn("later", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("updated_at")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.join(so_far.where(F.col("later") < limit), "updated_at")
    whole = placed.where(F.col("later") + F.col("n") <= limit)
    part = placed.where(F.col("later") + F.col("n") > limit).withColumn("place", F.row_number().over(Window.partitionBy("updated_at").orderBy("id"))).where(F.col("later") + F.col("place") <= limit)
    return whole.select(rows.columns).unionByName(part.select(rows.columns))


def cancel(jobs: DataFrame, now, queue: str | None = None, job_type: str | None = None, entity_id: int | None = None, with_claimed: bool = False, changed: bool = False) -> DataFrame:
    """Cancels open jobs that fit all given filters; empty strings count as not given."""
    allowed = ["queued", "retry", *(["claimed"] if with_claimed else [])]
    wanted = [F.col("status").isin(*allowed)]
    wanted += [F.col(c) == v for c, v in (("queue_name", queue), ("job_type", job_type)) if v]
    wanted += [F.col("entity_id") == entity_id] if entity_id is not None else []
    return _updated(jobs, reduce(lambda a, b: a & b, wanted), now, changed, status=F.lit("cancelled"))


def depth(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("queue_name", "status").agg(F.count("*").alias("n"))


def depth_by_queue(jobs: DataFrame) -> DataFrame:
    """A map of counts by status for each queue."""
    return depth(jobs).groupBy("queue_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))


def dead_letters(jobs: DataFrame, limit: int = 10) -> DataFrame:
    return jobs.where(F.col("status") == "dead").orderBy(F.desc("updated_at"), "id").limit(limit)


def recent_failures(attempts: DataFrame, limit: int = 10) -> DataFrame:
    return attempts.where(F.col("outcome").isin("retryable_fail", "permanent_fail")).orderBy(F.desc("finished_at"), "id").limit(limit)


def register_worker(workers: DataFrame, now, worker_id: str, worker_type: str, backend: str, policy: Policy = Policy()) -> DataFrame:
    """The workers table with this one running; others of its type that were running are stopped."""
    rest = _stopped(workers.where(F.col("worker_id") != worker_id), worker_type)
    own = workers.sparkSession.range(1).select(F.lit(worker_id).alias("worker_id"), F.lit(worker_type).alias("worker_type"), F.lit(backend).alias("backend_name"), F.lit(None).cast("string").alias("backend_version"), config_hash(*map(F.lit, policy.settings())).alias("config_hash"), instant(now).alias("started_at"), instant(now).alias("last_heartbeat_at"), F.lit("running").alias("status"))
    return rest.unionByName(own, allowMissingColumns=True)


def _stopped(workers: DataFrame, worker_type: str) -> DataFrame:
    old = (F.col("worker_type") == worker_type) & (F.col("status") == "running")
    return workers.withColumn("status", F.when(old, F.lit("stopped")).otherwise(F.col("status")))


def heartbeat(workers: DataFrame, now, worker_id: str, status: str = "running") -> DataFrame:
    own = F.col("worker_id") == worker_id
    return workers.withColumn("last_heartbeat_at", F.when(own, instant(now)).otherwise(F.col("last_heartbeat_at"))).withColumn("status", F.when(own, F.lit(status)).otherwise(F.col("status")))
