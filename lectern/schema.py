"""Tables of the library, their enumerations, and additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType(), False)}


def _struct(text: str) -> T.StructType:
    """From "name kind" items; a kind ending in ! is not null."""
    fields = []
    for item in text.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, _kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


TABLES = {
    "references": _struct("id long, canonical_key string, title string, authors string, year string, source_system string!, source_id string!, metadata string, created_at timestamp, updated_at timestamp"),
    "reference_external_ids": _struct("id long, reference_id long!, scheme string!, value string!"),
    "document_files": _struct(
        "id long, reference_id long!, file_path string!, mime_type string, extracted_text string, extraction_status string, extraction_error string, metadata_json string, source_system string, source_id string, created_at timestamp,"
        " extraction_backend string, extraction_backend_version string, storage_kind string, storage_uri string"
    ),
    "documents": _struct(
        "id long, reference_id long!, document_file_id long, kind string!, content string, chunk_index int, metadata_json string, embedding_status string, embedding_updated_at timestamp, embedding_error string, source_system string,"
        " source_id string, created_at timestamp, updated_at timestamp, embedding_backend string, embedding_model string"
    ),
    "vectors": _struct("doc_id long, embedding vector"),
    "jobs": _struct(
        "id string, queue_name string!, job_type string!, entity_type string!, entity_id long!, dedupe_key string!, payload_json string, status string!, priority int, available_at timestamp!, claimed_by string, claim_token string,"
        " claim_expires_at timestamp, attempts int, max_attempts int, last_error string, created_at timestamp!, updated_at timestamp!"
    ),
    "job_attempts": _struct("id string, job_id string!, attempt_no int!, worker_id string!, backend_name string, backend_version string, started_at timestamp!, finished_at timestamp, outcome string, error_class string, error_message string, metrics_json string"),
    "worker_runs": _struct("worker_id string, worker_type string!, backend_name string!, backend_version string, config_hash string, started_at timestamp!, last_heartbeat_at timestamp!, status string!"),
}
#: What tells rows of a table apart.
KEYS = {name: ("doc_id",) if name == "vectors" else ("worker_id",) if name == "worker_runs" else ("id",) for name in TABLES}
#: What a missing column holds in rows written before it was added.
DEFAULTS = {"document_files": {"extraction_status": "pending", "storage_kind": "local"}, "documents": {"embedding_status": "pending"}, "jobs": {"priority": 100, "attempts": 0, "max_attempts": 5}}

KINDS = ("title", "abstract", "annotation", "note", "fulltext_chunk")
EMBEDDING_STATUS = ("pending", "ready", "error", "skipped")
EXTRACTION_STATUS = ("pending", "ready", "error", "skipped")
JOB_STATUS = ("queued", "claimed", "succeeded", "retry", "dead", "cancelled")
OUTCOMES = ("succeeded", "retryable_fail", "permanent_fail")
ERROR_CLASSES = ("retryable_io", "retryable_rate_limit", "retryable_timeout", "permanent_validation", "permanent_not_found", "permanent_unsupported")


def evolved(df: DataFrame, name: str) -> DataFrame:
    """df with every column of the table, in its order; columns it lacks hold their default or null, others are kept last."""
    defaults = DEFAULTS.get(name, {})
    for f in TABLES[name]:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(defaults.get(f.name)).cast(f.dataType))
    known = TABLES[name].names
    return df.select(*known, *(c for c in df.columns if c not in known))


def invalid(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose status or kind is none of the allowed ones."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
