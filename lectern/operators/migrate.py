"""Migration of old tables: reasons, changes, and digests that must not change."""

from __future__ import annotations

import ctypes
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.scratch import new_path

#: What a check reports.
REASONS = {
    "pdf_chunk": "documents.kind contains legacy 'pdf_chunk' rows",
    "embedding": "documents.embedding_status contains in-flight 'embedding' rows",
    "extracting": "document_files.extraction_status contains in-flight 'extracting' rows",
    "storage_uri": "document_files.storage_uri has missing values",
    "storage_kind": "document_files.storage_kind has missing values",
    "empty": "documents.fulltext_chunk has pending rows with empty content",
}
REPAIRED = "legacy repair: empty fulltext chunk"


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def _empty_chunk() -> Column:
    return F.col("kind").isin("fulltext_chunk", "pdf_chunk") & (F.col("embedding_status") == "pending") & _blank("content")


def reasons(documents: DataFrame, files: DataFrame) -> DataFrame:
    """One row: the array of what is to be migrated."""
    d = documents.agg(F.count_if(F.col("kind") == "pdf_chunk").alias("pdf_chunk"), F.count_if(F.col("embedding_status") == "embedding").alias("embedding"), F.count_if((F.col("kind") == "fulltext_chunk") & _empty_chunk()).alias("empty"))
    checks = {"extracting": F.col("extraction_status") == "extracting"} | {c: _blank(c) for c in ("storage_uri", "storage_kind") if c in files.columns}
    f = files.agg(*(F.count_if(p).alias(k) for k, p in checks.items()))
    both = d.withColumn("one", F.lit(1)).join(F.broadcast(f.withColumn("one", F.lit(1))), "one")  # one row each
    found = [F.when(F.col(k) > 0, F.lit(text)) for k, text in REASONS.items() if k in both.columns]
    return both.select(F.array_compact(F.array(*found)).alias("reasons"))


def migrated_documents(documents: DataFrame) -> DataFrame:
    """Chunks under their new kind, unfinished embeddings pending again, pending chunks without content an error."""
    empty = _empty_chunk()
    status = F.when(F.col("embedding_status") == "embedding", F.lit("pending")).when(empty, F.lit("error")).otherwise(F.col("embedding_status"))
    error = F.when(empty, F.lit(REPAIRED)).otherwise(F.col("embedding_error") if "embedding_error" in documents.columns else F.lit(None).cast("string"))
    return documents.withColumns({"kind": F.when(F.col("kind") == "pdf_chunk", F.lit("fulltext_chunk")).otherwise(F.col("kind")), "embedding_status": status, "embedding_error": error})


def migrated_files(files: DataFrame) -> DataFrame:
    have = lambda c: F.col(c) if c in files.columns else F.lit(None).cast("string")
    filled = lambda c, value: F.coalesce(F.when(F.trim(have(c)) != "", have(c)), value)
    status = F.when(F.col("extraction_status") == "extracting", F.lit("pending")).otherwise(F.col("extraction_status"))
    return files.withColumns({"storage_kind": filled("storage_kind", F.lit("local")), "storage_uri": filled("storage_uri", F.col("file_path")), "extraction_status": status})


def change_counts(documents: DataFrame, files: DataFrame) -> DataFrame:
    """One row of how many rows each change touches."""
    d = documents.agg(F.count_if(F.col("kind") == "pdf_chunk").alias("renamed"), F.count_if(F.col("embedding_status") == "embedding").alias("requeued_embeddings"), F.count_if(_empty_chunk()).alias("repaired"))
    uri = _blank("storage_uri") if "storage_uri" in files.columns else F.lit(True)
    f = files.agg(F.count_if(uri).alias("storage_uris"), F.count_if(F.col("extraction_status") == "extracting").alias("requeued_extractions"))
    return d.withColumn("one", F.lit(1)).join(F.broadcast(f.withColumn("one", F.lit(1))), "one").drop("one")


#: Bytes of records that one task hashes at most, if no record is longer.
PART_BYTES = 64 << 20


def _libcrypto() -> ctypes.CDLL | None:
    """The library that hashlib itself uses, if its SHA-256 with a state is in reach: what hashlib gives cannot be handed to another process."""
    try:
        import _hashlib

        found = ctypes.CDLL(_hashlib.__file__)
        return found if all(hasattr(found, f"SHA256_{f}") for f in ("Init", "Update", "Final")) else None
    except (ImportError, AttributeError, OSError):
        return None


class _Sha256:
    """SHA-256 that goes on from a state (SHA256_CTX: 112 bytes, which nobody looks into)."""

    def __init__(self, state: bytes | None = None) -> None:
        self.library, self.held = _libcrypto(), ctypes.create_string_buffer(112)
        if state is None:
            self.library.SHA256_Init(self.held)
        else:
            self.held.raw = state

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(self.held, ctypes.c_char_p(data), ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.held.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.library.SHA256_Final(out, self.held)
        return out.raw.hex()


def _hashed(batches: Iterator[pa.RecordBatch], sha) -> Iterator[pa.RecordBatch]:
    rows, chars = 0, 0
    for batch in batches:
        rows += batch.num_rows
        chars += pc.sum(batch.column(1)).as_py() or 0
        sha.update(b"".join(r.as_py() or b"" for r in batch.column(0)))
    yield pa.RecordBatch.from_pydict({"rows": [rows], "total_chars": [chars], "sha256": [sha.state() if isinstance(sha, _Sha256) else sha.digest()]})


def _record(id_col: str, text_col: str) -> Column:
    return F.concat(F.col(id_col).cast("string"), F.lit("\x1f"), F.coalesce(F.col(text_col), F.lit("")), F.lit("\x1e"))


def text_digest(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rows, total_chars and a digest of all ids and texts at any size: sums of the eight parts of each row's own SHA-256, in which no order and no group matters, hashed once more."""
    record = F.sha2(_record(id_col, text_col), 256)
    parts = [F.sum(F.conv(F.substring(record, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).alias(f"part{k}") for k in range(8)]
    sums = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("long").alias("total_chars"), *parts)
    return sums.select("rows", "total_chars", F.sha2(F.concat_ws("|", *(F.col(f"part{k}").cast("string") for k in range(8))), 256).alias("sha256"))


def ordered_text_digest(rows: DataFrame, id_col: str, text_col: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """rows, total_chars and the SHA-256 of id, 0x1F, text, 0x1E of all rows in the order of ids, for comparisons with digests that were taken
    so. Records are dealt by ranges of ids into parts of part_bytes in the shared folder. As this hash can only be taken in order, parts are
    hashed one after another, each by a task that goes on from the state that the one before it has left. Runs at once."""
    spark = rows.sparkSession
    records = rows.select(F.col(id_col).alias("i"), _record(id_col, text_col).cast("binary").alias("r"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"))
    schema = "rows long, total_chars long, sha256 binary"
    in_order = lambda part, begin: part.sortWithinPartitions("i", "r").select("r", "n").mapInArrow(lambda batches: _hashed(batches, begin()), schema).first()
    if _libcrypto() is None:  # no state can be handed on: one task for all
        n, chars, digest = in_order(records.repartition(1), hashlib.sha256)
        return spark.createDataFrame([(n, chars, bytes(digest).hex())], "rows long, total_chars long, sha256 string")
    size = records.agg(F.sum(F.octet_length("r"))).first()[0] or 0
    path = new_path(spark, "ordered")
    # rows of one id lie in the order of their records
    dealt = records.repartitionByRange(max(1, math.ceil(size / part_bytes)), "i", F.substring("r", 1, 64))
    dealt.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(path)
    kinds = dealt.schema
    parts = sorted(r["part"] for r in spark.read.schema(f"i {kinds['i'].dataType.simpleString()}, part int").parquet(path).select("part").distinct().collect()) if size else []
    n, chars, state = 0, 0, _Sha256().state()
    for k in parts:
        part = spark.read.schema(kinds).parquet(f"{path}/part={k}").coalesce(1)
        more, more_chars, state = in_order(part, lambda state=bytes(state): _Sha256(state))
        n, chars = n + more, chars + more_chars
    return spark.createDataFrame([(n, chars, _Sha256(bytes(state)).hexdigest())], "rows long, total_chars long, sha256 string")


def check_unchanged(before: DataFrame, after: DataFrame) -> None:
    """Raises unless two digests (a row each) are equal."""
    a, b = before.first(), after.first()
    if a != b:
        raise ValueError(f"texts changed: {a} is now {b}")
