"""The corpus pipeline: each stage works on all that its predecessor kept, and takes away what it rejects.

Filters that look at one document judge each row: only its text goes to Python, only a verdict comes back, and nothing is
shuffled. The near-duplicate stage knows rows by a key of their own, so rows with null or repeated doc_id are matched by text
like all others, and one row of each group stays. Ties: of a group the smallest doc_id stays, of rows that share it the first
one read; other ties are broken as each operator says. Very long texts are judged whole, in parts where a stage needs memory beside
them. Rows without a text or a language go with the first stage. An empty table gives no rows. Extra columns of documents are carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, language, neardup, packing, quality
from lectern.llm.common import cut, table


def _carried(docs: DataFrame) -> DataFrame:
    """What a filter reads, beside the whole row in one column, whatever its columns are called."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")
    return docs.select(whole, "doc_id", "text")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: those without letters and those between two languages."""
    found = language.identify(_carried(docs), language.learn_from_folds(docs), ["document"])
    return found.where(f"lang_pred <> '{language.UNDETERMINED}' AND NOT ambiguous").select("document.*")


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the quality rules or the likelihood ratio."""
    return quality.judge(_carried(docs), table(spark, sf_dir, "labels"), ["document"]).where("kept").select("document.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: of those with the smallest doc_id (nulls are last), the first."""
    key = "row_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    keyed = cut(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = neardup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("k"), "component_id")
    members = keyed.select(F.col(key).alias("k"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("k")).alias("place")).join(found, "k")
    # stored before they are joined, so that a group of many copies can be split or a small table of groups sent to all tasks
    members = cut(members, "members")
    groups = cut(members.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    dropped = members.join(groups, "component_id").where("k <> first.k").select(F.col("k").alias(key))
    return keyed.join(dropped, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs."""
    found = decontaminate.contamination(_carried(docs), table(spark, sf_dir, "benchmark"), carried=["document"])
    return found.where("size(items) = 0").select("document.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs)


STAGES = [("language id", identified), ("quality rules", judged), ("minhash near-dedup", deduplicated), ("benchmark decontamination", decontaminated), ("packing", packed)]

#: SQL can express neither the classifiers nor the tokenizer; the tests hold the whole against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name.replace(" ", "-"))
    return docs
