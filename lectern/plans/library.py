"""One synchronisation of a library: the source's items and their children against the stored tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.html import note_text
from lectern.operators import sync
from lectern.scratch import cut

SYSTEM = "zotero"
ARTIFACTS = ("References", "Documents", "Document files", "Annotations", "Notes")


def stable_id(*keys: str) -> Column:
    """A positive id that follows from the natural key."""
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 63) - 1))


@dataclass
class Source:
    """What a scan gives: items(key, title, abstract_note, year, authors), attachments(key, parent_key, mime_type, file_path), annotations, notes(key, parent_key, title, note)."""

    items: DataFrame
    attachments: DataFrame | None = None
    annotations: DataFrame | None = None
    notes: DataFrame | None = None


@dataclass
class Synced:
    references: DataFrame
    files: DataFrame
    documents: DataFrame
    counts: DataFrame

    def report(self) -> str:
        return sync.report(self.counts)


def _documents(source: Source) -> DataFrame:
    """All documents of a scan: source_id, kind, content, metadata_json, owner (item key), attachment_key."""
    none = F.lit(None).cast("string")
    item = source.items.select("key", F.expr("stack(2, 'title', title, 'abstract', abstract_note) AS (kind, raw)"))
    parts = [item.select(F.col("key").alias("source_id"), "kind", T.normalize_content(F.col("raw")).alias("content"), none.alias("metadata_json"), F.col("key").alias("owner"), none.alias("attachment_key"))]
    if source.annotations is not None:
        a = source.annotations
        fields = {"schema_version": F.lit(1), "annotation_type": F.col("type"), "author_name": F.col("authorName"), "color": F.col("color"), "page_label": F.col("pageLabel"), "sort_index": F.col("sortIndex"), "position": F.col("position"), "is_external": F.col("isExternal"), "attachment_key": F.col("attachment_key")}
        parts.append(a.select(F.col("key").alias("source_id"), F.lit("annotation").alias("kind"), T.annotation_content(F.col("text"), F.col("comment")).alias("content"), T.canonical_json(**fields).alias("metadata_json"), F.col("parent_key").alias("owner"), "attachment_key"))
    if source.notes is not None:
        n = source.notes
        fields = {"schema_version": F.lit(1), "title": F.col("title"), "parent_item_id": F.col("parent_key")}
        parts.append(n.select(F.col("key").alias("source_id"), F.lit("note").alias("kind"), T.normalize_content(note_text(F.col("note"))).alias("content"), T.canonical_json(**fields).alias("metadata_json"), F.col("parent_key").alias("owner"), none.alias("attachment_key")))
    return reduce(DataFrame.unionByName, parts)


def _files(source: Source) -> DataFrame:
    """Attachments as files: owner, file_path and what a synchronisation says of them."""
    a = source.attachments
    if a is None:
        a = source.items.limit(0).select("key", F.lit("").alias("parent_key"), F.lit("").alias("mime_type"), F.lit("").alias("file_path"))
    extra = {c: F.col(c) if c in a.columns else F.lit(None).cast("long") for c in ("item_id", "link_mode")}
    told = T.canonical_json(schema_version=F.lit(1), attachment_key=F.col("key"), attachment_item_id=extra["item_id"], link_mode=extra["link_mode"])
    return a.select(
        F.col("parent_key").alias("owner"), "file_path", T.canonical_mime(F.col("mime_type")).alias("mime_type"), F.lit(SYSTEM).alias("source_system"), F.col("key").alias("source_id"), F.lit("local").alias("storage_kind"), F.col("file_path").alias("storage_uri"), told.alias("metadata_json"),
    )


def _kept(old: DataFrame, columns: list[str]) -> DataFrame:
    """Missing columns of a stored table as null."""
    return old.select(*(F.col(c) if c in old.columns else F.lit(None).cast("string").alias(c) for c in columns))


def synchronize(source: Source, references: DataFrame, files: DataFrame, documents: DataFrame, mirror: bool = False) -> Synced:
    """The next tables and the counts. Nothing is deleted, unless the source is mirrored; a changed text is pending again, an unchanged one keeps its state."""
    ref_cols = ["title", "authors", "year"]
    new_refs = source.items.select(F.col("key").alias("source_id"), *ref_cols)
    ref_changes = cut(sync.diff(_kept(references, ["source_id", *ref_cols]), new_refs, ["source_id"], ref_cols), "references")

    doc_cols = ["content", "metadata_json", "owner", "attachment_key"]
    new_docs = _documents(source)
    doc_changes = cut(sync.diff(_kept(documents, ["source_id", "kind", *doc_cols]), new_docs, ["source_id", "kind"], doc_cols), "documents")

    file_cols = ["mime_type", "source_system", "source_id", "storage_kind", "storage_uri", "metadata_json", "extraction_status"]
    old_files = _kept(files, ["owner", "file_path", "extracted_text", *file_cols])
    # a file without text is pending whatever its state says, one with text keeps its state
    state = old_files.select("owner", "file_path", F.when(F.col("extracted_text").isNotNull(), F.coalesce("extraction_status", F.lit("pending"))).alias("kept_status"))
    new_files = _files(source).join(state, ["owner", "file_path"], "left").withColumn("extraction_status", F.coalesce("kept_status", F.lit("pending"))).drop("kept_status")
    file_changes = cut(sync.diff(old_files, new_files, ["owner", "file_path"], file_cols), "files")

    next_refs = sync.merged(ref_changes, ["source_id"], ref_cols, mirror).drop("outcome").withColumn("id", stable_id("source_id")).withColumn("source_system", F.lit(SYSTEM))
    state = documents.select("source_id", "kind", F.col("embedding_status").alias("status_before")) if "embedding_status" in documents.columns else documents.select("source_id", "kind", F.lit(None).cast("string").alias("status_before"))
    next_docs = sync.merged(doc_changes, ["source_id", "kind"], doc_cols, mirror).join(state, ["source_id", "kind"], "left")
    fresh = F.when(F.col("content").isNotNull(), F.lit("pending")).otherwise(F.lit("skipped"))
    next_docs = next_docs.withColumn("embedding_status", F.when(F.col("outcome").isin("added", "updated"), fresh).otherwise(F.coalesce("status_before", fresh))).drop("outcome", "status_before").withColumn("id", stable_id("kind", "source_id")).withColumn("reference_id", stable_id("owner")).withColumn("source_system", F.lit(SYSTEM))
    next_files = sync.merged(file_changes, ["owner", "file_path"], file_cols, mirror).join(old_files.select("owner", "file_path", "extracted_text"), ["owner", "file_path"], "left")
    next_files = next_files.drop("outcome").withColumn("id", stable_id("owner", "file_path")).withColumn("reference_id", stable_id("owner"))

    kind = F.when(F.col("kind") == "annotation", F.lit("Annotations")).when(F.col("kind") == "note", F.lit("Notes")).otherwise(F.lit("Documents"))
    told = ref_changes.select(F.lit("References").alias("artifact"), "outcome").unionByName(doc_changes.select(kind.alias("artifact"), "outcome")).unionByName(file_changes.select(F.lit("Document files").alias("artifact"), "outcome"))
    counts = sync.counts(told, F.col("artifact"))
    every = references.sparkSession.createDataFrame([(a,) for a in (*ARTIFACTS, "Total")], "artifact string")
    counts = every.join(F.broadcast(counts), "artifact", "left").fillna(0)  # six rows
    return Synced(next_refs, next_files, next_docs, counts)
