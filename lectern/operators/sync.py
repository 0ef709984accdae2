"""Change detection between a stored snapshot and a new one: outcomes, the next snapshot, counts and the jobs they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import PDF, guessed_mime, normalize_content

OUTCOMES = ("added", "updated", "unchanged")


def differs(old: Column, new: Column) -> Column:
    """Whether a stored value (empty counts as null) is another than the new one."""
    return ~F.nullif(old.cast("string"), F.lit("")).eqNullSafe(new.cast("string"))


def last_of(rows: DataFrame, keys: list[str], values: list[str], order: str | None = None) -> DataFrame:
    """One row for each key: the one that comes last by `order`; without one, or where that is equal, the one with the largest values."""
    held = F.struct(*(F.col(c) for c in values))
    picked = F.max(held) if order is None else F.max_by(held, F.struct(F.col(order), held))
    return rows.groupBy(*keys).agg(picked.alias("last_row")).select(*keys, *(F.col(f"last_row.{c}").alias(c) for c in values))


def diff(stored: DataFrame, incoming: DataFrame, keys: list[str], compared: list[str], order: str | None = None) -> DataFrame:
    """Full outer join on the natural key: keys, old_* and new_* of the compared columns, and the outcome (absent: only stored). Of incoming rows with one key the last counts."""
    old = stored.select(*keys, *(F.col(c).alias(f"old_{c}") for c in compared), F.lit(True).alias("in_stored"))
    new = last_of(incoming, keys, compared, order).select(*keys, *(F.col(c).alias(f"new_{c}") for c in compared), F.lit(True).alias("in_new"))
    rows = old.join(new, keys, "full_outer")
    changed = F.lit(False)
    for c in compared:
        changed = changed | differs(F.col(f"old_{c}"), F.col(f"new_{c}"))
    outcome = F.when(F.col("in_new").isNull(), F.lit("absent")).when(F.col("in_stored").isNull(), F.lit("added")).when(changed, F.lit("updated")).otherwise(F.lit("unchanged"))
    return rows.select(*keys, *(f"old_{c}" for c in compared), *(f"new_{c}" for c in compared), outcome.alias("outcome"))


def merged(changes: DataFrame, keys: list[str], compared: list[str], mirror: bool = False) -> DataFrame:
    """The next snapshot: new values where there are any; stored rows that are gone stay, unless it is to mirror the source."""
    rows = changes.where("outcome <> 'absent'") if mirror else changes
    return rows.select(*keys, *(F.when(F.col("outcome").isin("added", "updated"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in compared), "outcome")


def counts(changes: DataFrame, artifact: str | Column) -> DataFrame:
    """added, updated, unchanged and changed (added or updated) by artifact, with a Total."""
    name = F.lit(artifact) if isinstance(artifact, str) else artifact
    rows = changes.where(F.col("outcome").isin(*OUTCOMES)).select(name.alias("artifact"), "outcome")
    each = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    total = rows.rollup("artifact").agg(*each)
    return total.select(F.coalesce("artifact", F.lit("Total")).alias("artifact"), *OUTCOMES, (F.col("added") + F.col("updated")).alias("changed"))


def report(counted: DataFrame) -> str:
    """The counts (a row for each artifact) as a Markdown table."""
    rows = {r["artifact"]: r for r in counted.collect()}
    total = rows.pop("Total", None)
    lines = ["| Artifact | Added | Updated | Unchanged | Changed |", "|---|---|---|---|---|"]
    for r in [*(rows[k] for k in sorted(rows)), *([total] if total else [])]:
        lines.append("| " + " | ".join(str(r[c]) for c in ("artifact", "added", "updated", "unchanged", "changed")) + " |")
    head = "Changes detected" if total and total["changed"] else "No library changes detected"
    return head + "\n\n" + "\n".join(lines)


def item_documents(items: DataFrame) -> DataFrame:
    """Title and abstract documents of items (key, title, abstract_note): normalised, skipped where nothing is left."""
    rows = items.select("key", F.expr("stack(2, 'title', title, 'abstract', abstract_note) AS (kind, raw)"))
    content = normalize_content(F.col("raw"))
    return rows.select(F.col("key").alias("source_id"), "kind", content.alias("content"), F.when(content.isNotNull(), F.lit("pending")).otherwise(F.lit("skipped")).alias("embedding_status"))


def extraction_candidates(files: DataFrame, mime_types: tuple[str, ...] = (PDF,)) -> DataFrame:
    """Jobs for files to extract: those of a type that can be, whose extraction is pending or failed."""
    wanted = files.where(F.col("extraction_status").isin("pending", "error") & guessed_mime(F.col("mime_type"), F.col("file_path")).isin(*mime_types))
    return wanted.select(F.lit("extraction").alias("queue_name"), F.lit("extract_file").alias("job_type"), F.lit("document_file").alias("entity_type"), F.col("id").alias("entity_id"), F.concat_ws(":", F.lit("extract_file"), F.col("id").cast("string")).alias("dedupe_key"))


def embedding_candidates(documents: DataFrame) -> DataFrame:
    """Jobs for documents to embed; the key holds the content's hash, so that a changed text is embedded again."""
    wanted = documents.where(F.col("embedding_status").isin("pending", "error") & (F.coalesce(F.trim("content"), F.lit("")) != ""))
    key = F.concat_ws(":", F.lit("embed_document"), F.col("id").cast("string"), F.substring(F.sha2("content", 256), 1, 16))
    return wanted.select(F.lit("embedding").alias("queue_name"), F.lit("embed_document").alias("job_type"), F.lit("document").alias("entity_type"), F.col("id").alias("entity_id"), key.alias("dedupe_key"))


def replace_chunks(documents: DataFrame, new_chunks: DataFrame, file_col: str = "document_file_id") -> DataFrame:
    """The documents table with the chunks of every file in new_chunks replaced by the new ones."""
    gone = new_chunks.select(file_col).distinct()
    kept = documents.where("kind <> 'fulltext_chunk'").unionByName(documents.where("kind = 'fulltext_chunk'").join(gone, file_col, "left_anti"))
    return kept.unionByName(new_chunks, allowMissingColumns=True)


def upsert_vectors(vectors: DataFrame, new: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """Stored vectors with new ones in the place of those with their key; of new rows with one key the last counts."""
    return vectors.join(new.select(key), key, "left_anti").unionByName(last_of(new, [key], [c for c in vectors.columns if c != key], order))
