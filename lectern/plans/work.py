"""A round of the workers: claimed jobs are carried out, and the next tables come back together.

Each round is a few joins over the batch: the jobs claimed, their files or documents, and what the model made of them. A bad
input is a row with an error class; its job is tried again or dies, and no other row is touched."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, sync
from lectern.operators import jobs as J
from lectern.operators.providers import Embedder, Extractor, embed_column
from lectern.scratch import cut
from lectern.sources.files import located
from lectern.streaming.queue import extracted

SUPPORTED = (T.PDF,)


@dataclass
class Done:
    jobs: DataFrame
    attempts: DataFrame
    files: DataFrame | None = None
    documents: DataFrame | None = None
    vectors: DataFrame | None = None


def _claimed(jobs: DataFrame, now, worker: str, policy: J.Policy, queue: str) -> tuple[DataFrame, DataFrame]:
    """The jobs table after reclaiming and claiming, and the rows claimed now."""
    after = cut(J.claim(J.reclaim_expired(jobs, now, policy), now, worker, policy, queue), "jobs")
    before = jobs.select("id", F.col("claim_token").alias("token_before"))
    mine = after.where((F.col("status") == "claimed") & (F.col("claimed_by") == worker)).join(before, "id").where("NOT claim_token <=> token_before").drop("token_before")
    return after, mine


def _finished(jobs: DataFrame, mine: DataFrame, told: DataFrame, now, worker: str, backend: str, policy: J.Policy) -> tuple[DataFrame, DataFrame]:
    """told: entity_id, error_class, error_message, metrics_json. The jobs table after completion, and the attempts."""
    done = mine.select("id", F.col("claim_token").alias("token"), "attempts", "entity_id").join(told, "entity_id")
    outcome = F.when(F.col("error_class").isNull(), F.lit("succeeded")).when(F.col("error_class").startswith("permanent_"), F.lit("permanent_fail")).otherwise(F.lit("retryable_fail"))
    key = F.sha2(F.concat_ws("|", "id", "attempts"), 256)
    attempts = done.select(key.alias("id"), F.col("id").alias("job_id"), F.col("attempts").alias("attempt_no"), F.lit(worker).alias("worker_id"), F.lit(backend).alias("backend_name"), J.instant(now).alias("started_at"), J.instant(now).alias("finished_at"), outcome.alias("outcome"), "error_class", "error_message", "metrics_json")
    return cut(J.complete(jobs, done.select("id", "token", "error_class", "error_message"), now, policy), "jobs"), attempts


def extract(jobs: DataFrame, files: DataFrame, documents: DataFrame, contents: DataFrame, make: Callable[[], Extractor], now, worker: str = "extraction-1", policy: J.Policy = J.Policy(), supported: tuple[str, ...] = SUPPORTED) -> Done:
    """Extraction jobs: files get their text, documents their chunks with page ranges. contents: path, content."""
    backend = make().name
    after, mine = _claimed(jobs, now, worker, policy, "extraction")
    rows = located(files.join(mine.select(F.col("entity_id").alias("id")), "id", "left_semi")).withColumn("mime", T.guessed_mime(F.col("mime_type"), F.col("file_path")))
    usable = rows.where(F.coalesce(F.col("mime").isin(*supported), F.lit(False)))
    found = usable.where("error_class IS NULL").select("id", "path").join(contents, "path")
    texts = extracted(found.select("path", "content").dropDuplicates(["path"]), make)
    made = found.select("id", "path").join(texts, "path").select("id", "page_texts", "extracted_text", "extraction_status", "error_class", "error_message")
    none = F.lit(None).cast("string")
    lost = usable.join(made.select("id"), "id", "left_anti").select("id", F.lit(None).cast("array<string>").alias("page_texts"), none.alias("extracted_text"), F.lit("error").alias("extraction_status"), F.coalesce("error_class", F.lit("permanent_not_found")).alias("error_class"), F.concat(F.lit("no file: "), F.coalesce("path", F.lit(""))).alias("error_message"))
    skipped = rows.join(usable.select("id"), "id", "left_anti").select("id", F.lit(None).cast("array<string>").alias("page_texts"), none.alias("extracted_text"), F.lit("skipped").alias("extraction_status"), none.alias("error_class"), F.concat(F.lit(backend + " does not support mime type "), F.coalesce("mime", F.lit("unknown"))).alias("error_message"))
    result = cut(cut(made, "extracted").unionByName(lost).unionByName(skipped), "extracted")

    ready = result.where("extraction_status = 'ready'")
    parts = chunking.chunks(ready, "id", "extracted_text", spans=True)
    placed = chunking.with_pages(parts, chunking.page_rows(ready, "id", "page_texts"))
    loc = F.when(F.col("page_start").isNotNull(), F.struct(F.col("page_end").alias("page_end"), F.col("page_start").alias("page_start")))
    meta = F.to_json(F.struct(loc.alias("loc"), F.lit("extraction").alias("origin"), F.lit(1).alias("schema_version")))
    new = placed.select(F.xxhash64(F.lit("chunk"), "id", "chunk_index").bitwiseAND(F.lit((1 << 63) - 1)).alias("id"), F.col("id").alias("document_file_id"), F.lit("fulltext_chunk").alias("kind"), "content", "chunk_index", meta.alias("metadata_json"), F.lit("pending").alias("embedding_status"))
    owner = files.select(F.col("id").alias("document_file_id"), "reference_id")
    new = cut(new.join(owner, "document_file_id"), "chunks")

    told = result.select(F.col("id").alias("entity_id"), "error_class", "error_message", F.when(F.col("extraction_status") == "skipped", F.lit('{"skipped":1}')).otherwise(F.to_json(F.struct(F.length("extracted_text").alias("text_chars")))).alias("metrics_json"))
    jobs_done, attempts = _finished(after, mine, told, now, worker, backend, policy)
    wanted = sync.embedding_candidates(new)
    fresh = cut(J.new_jobs(wanted, jobs_done), "jobs")
    jobs_next = jobs_done.unionByName(J.queued(fresh, now, policy), allowMissingColumns=True).select(jobs.columns)

    told_file = result.select("id", F.col("extracted_text").alias("new_text"), F.col("extraction_status").alias("new_status"), F.col("error_message").alias("new_error"), F.lit(True).alias("told"))
    change: dict[str, Column] = {"extracted_text": F.col("new_text"), "extraction_status": F.col("new_status"), "extraction_error": F.col("new_error"), "extraction_backend": F.lit(backend)}
    joined = files.join(told_file, "id", "left")
    files_next = joined.select(*(F.when(F.col("told"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in files.columns))
    return Done(jobs_next, attempts, files_next, sync.replace_chunks(documents, new).select(documents.columns))


def embed(jobs: DataFrame, documents: DataFrame, vectors: DataFrame, make: Callable[[], Embedder], now, worker: str = "embedding-1", policy: J.Policy = J.Policy()) -> Done:
    """Embedding jobs: documents get their vectors; what is blank fails for good."""
    model = make()
    after, mine = _claimed(jobs, now, worker, policy, "embedding")
    rows = documents.join(mine.select(F.col("entity_id").alias("id")), "id", "left_semi").select("id", "content")
    blank = T.is_blank_text(F.col("content"))
    made = cut(rows.select("id", blank.alias("blank"), embed_column(make)(F.when(~blank, F.col("content"))).alias("embedding")), "embedded")
    none = F.lit(None).cast("string")
    told = made.select(F.col("id").alias("entity_id"), F.when(F.col("blank"), F.lit("permanent_validation")).alias("error_class"), F.when(F.col("blank"), F.lit("the content is empty")).alias("error_message"), none.alias("metrics_json"))
    jobs_next, attempts = _finished(after, mine, told, now, worker, model.name, policy)
    change: dict[str, Column] = {"embedding_status": F.when(F.col("blank"), F.lit("error")).otherwise(F.lit("ready")), "embedding_error": F.when(F.col("blank"), F.lit("the content is empty")), "embedding_updated_at": F.when(~F.col("blank"), J.instant(now)), "embedding_backend": F.lit(model.name), "embedding_model": F.lit(model.version)}
    joined = documents.join(made.select("id", "blank"), "id", "left")
    docs_next = joined.select(*(F.when(F.col("blank").isNotNull(), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in documents.columns))
    new = made.where("NOT blank").select(F.col("id").alias("doc_id"), "embedding")
    return Done(jobs_next, attempts, documents=docs_next, vectors=sync.upsert_vectors(vectors, new))
