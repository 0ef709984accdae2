"""python -m lectern.cli --store FOLDER COMMAND: upkeep of the queue, migration and status."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from lectern.operators import jobs, status
from lectern.plans.migration import migrated
from lectern.plans.store import Store
from lectern.scratch import cut
from lectern.session import session
from lectern.settings import load

QUEUES = ("extraction", "embedding")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--store", required=True)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    requeue = sub.add_parser("requeue-dead")
    requeue.add_argument("--limit", type=int, help="the most recently updated ones only")
    requeue.add_argument("--reset-attempts", action="store_true")
    cancel = sub.add_parser("cancel")
    cancel.add_argument("--job-type")
    cancel.add_argument("--entity-id", type=int)
    cancel.add_argument("--include-claimed", action="store_true")
    for command in (requeue, cancel, sub.add_parser("cleanup-leases")):
        command.add_argument("--queue", choices=QUEUES)
    sub.add_parser("stats")
    sub.add_parser("status")
    migration = sub.add_parser("migrate")
    migration.add_argument("--dry-run", action="store_true")
    migration.add_argument("--no-jobs", action="store_true", help="do not seed the queue with what is pending")
    return p


def run(args: argparse.Namespace, now: datetime | None = None) -> dict:
    """What the command did, as a dictionary."""
    spark, now = session(args.master), now or datetime.now(timezone.utc).replace(tzinfo=None)
    store, policy = Store(spark, args.store), load().policy
    table = store.read("jobs")
    if args.command == "stats":
        return {r["queue_name"]: r["by_status"] for r in jobs.depth_by_queue(table).collect()}
    if args.command == "status":
        return status.library_status(*(store.read(t) for t in ("references", "documents", "document_files", "jobs", "worker_runs", "job_attempts")))
    if args.command == "migrate":
        return migrated(store, now, policy, args.dry_run, not args.no_jobs)

    def changes(table):
        if args.command == "requeue-dead":
            return jobs.requeue_dead(table, now, args.limit, args.reset_attempts, args.queue, changed=True)
        if args.command == "cancel":
            return jobs.cancel(table, now, args.queue, args.job_type, args.entity_id, args.include_claimed, changed=True)
        return jobs.reclaim_expired(table.where(F.col("queue_name") == args.queue) if args.queue else table, now, policy, changed=True)

    def merge(t):
        new = cut(changes(t.read("jobs")), "changes")
        t.merge("jobs", new)
        return new.count()

    return {"changed": store.update(merge)}


if __name__ == "__main__":
    print(json.dumps(run(parser().parse_args()), indent=2, default=str))
