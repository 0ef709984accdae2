"""What the library holds and how its work stands, in a few aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import jobs as J

PDF = "application/pdf"


def files_by_mime(files: DataFrame) -> DataFrame:
    """Null and empty types are both `unknown`, and counted together."""
    return files.groupBy(F.coalesce(F.nullif("mime_type", F.lit("")), F.lit("unknown")).alias("mime_type")).agg(F.count("*").alias("n"))


def by_kind_and_status(documents: DataFrame) -> DataFrame:
    named = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return documents.groupBy(named("kind", "unknown").alias("kind"), named("embedding_status", "null").alias("status")).agg(F.count("*").alias("n"))


def extraction_by_status(files: DataFrame, supported: tuple[str, ...] = (PDF,)) -> DataFrame:
    return files.where(F.col("mime_type").isin(*supported)).groupBy("mime_type", F.coalesce("extraction_status", F.lit("null")).alias("status")).agg(F.count("*").alias("n"))


def embedding_errors(documents: DataFrame, limit: int = 5) -> DataFrame:
    return documents.where(F.col("embedding_status") == "error").orderBy(F.desc("embedding_updated_at"), F.desc("id")).limit(limit).select(F.col("id").alias("doc_id"), "kind", F.col("embedding_error").alias("error"))


def extraction_errors(files: DataFrame, limit: int = 5) -> DataFrame:
    return files.where(F.col("extraction_status") == "error").orderBy(F.desc("id")).limit(limit).select(F.col("id").alias("file_id"), F.col("extraction_error").alias("error"))


def library_status(references: DataFrame, documents: DataFrame, files: DataFrame, jobs: DataFrame, workers: DataFrame, attempts: DataFrame) -> dict:
    """The whole report; every part is a small aggregate or a top-k."""
    nested = lambda df, a, b: {k: {r[b]: r["n"] for r in rows} for k, rows in _grouped(df.collect(), a).items()}
    plain = lambda df: [r.asDict() for r in df.collect()]
    return {
        "summary": {"references": references.count(), "documents": documents.count(), "files": files.count(), "files_by_mime": {r["mime_type"]: r["n"] for r in files_by_mime(files).collect()}},
        "embedding": nested(by_kind_and_status(documents), "kind", "status"),
        "extraction": nested(extraction_by_status(files), "mime_type", "status"),
        "queue": nested(J.depth(jobs), "queue_name", "status"),
        "workers": plain(workers),
        "errors": {"embedding": plain(embedding_errors(documents)), "extraction": plain(extraction_errors(files)), "recent_attempts": plain(J.recent_failures(attempts, 5)), "dead_jobs": plain(J.dead_letters(jobs, 5))},
    }


def _grouped(rows: list, key: str) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out
