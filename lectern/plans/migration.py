"""Migration of a store: what has to change, the change with its invariants, and the jobs that it leaves to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import jobs as J
from lectern.operators import migrate, sync
from lectern.plans.store import Store
from lectern.scratch import cut

CHUNKS = "kind IN ('pdf_chunk', 'fulltext_chunk')"


def seeded(jobs: DataFrame, documents: DataFrame, files: DataFrame, now, policy: J.Policy) -> DataFrame:
    """New jobs for files to extract and documents to embed that have none yet."""
    wanted = sync.extraction_candidates(files).unionByName(sync.embedding_candidates(documents))
    return J.queued(J.new_jobs(wanted, jobs), now, policy)


def migrated(store: Store, now, policy: J.Policy, dry_run: bool = False, seed: bool = True) -> dict:
    """Migrates a store that needs it, in one commit, and reports: reasons, numbers of rows changed, and of jobs seeded by queue. Texts must stay as they are."""
    t = store.transaction()
    docs, files = t.read("documents"), t.read("document_files")
    out = {"reasons": migrate.reasons(docs, files).first()["reasons"], **migrate.change_counts(docs, files).first().asDict()}
    if dry_run or not out["reasons"]:
        return out
    new_docs, new_files = migrate.migrated_documents(docs), migrate.migrated_files(files)
    if new_docs.where("kind = 'pdf_chunk'").limit(1).count():
        raise ValueError("chunks of the old kind are left")
    migrate.check_unchanged(*(migrate.text_digest(d.where(CHUNKS), "id", "content") for d in (docs, new_docs)))
    migrate.check_unchanged(*(migrate.text_digest(f, "id", "extracted_text") for f in (files, new_files)))
    t.write("documents", new_docs)
    t.write("document_files", new_files)
    if seed:
        fresh = cut(seeded(t.read("jobs"), new_docs, new_files, now, policy), "jobs")
        out["jobs"] = {r["queue_name"]: r["n"] for r in fresh.groupBy("queue_name").agg(F.count("*").alias("n")).collect()}
        t.merge("jobs", fresh)
    t.commit()
    return out


def opened(spark: SparkSession, root: str, now, policy: J.Policy = J.Policy(), seed: bool = False) -> tuple[Store, dict]:
    """A store ready for use, migrated first if it has to be; and the report."""
    store = Store(spark, root)
    return store, migrated(store, now, policy, seed=seed)
