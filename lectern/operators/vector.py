"""Exact nearest neighbours, their SQL table function, reranking and keyword filters.

The distance is computed in double. For one query the k nearest are a top-k over the scan (each task keeps k). A bounded set of
queries is handed to every task, where each block of vectors is compared with all of them by one
matrix product; more queries than that are compared by cells. Rows that this product, within its rounding, leaves in question get the distance itself, in the same
order of additions as l2(), and only the k first rows by (distance, vec_id) for each query leave a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries that are sent to every task; more are compared by cells.
QUERIES_AT_ONCE = 1024
#: Vectors that one matrix product takes.
BLOCK = 1024


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", metric: str = "l2") -> DataFrame:
    """The k nearest rows with their distance, nearest first, ties by id."""
    distance = {"l2": l2, "cosine": cosine_distance}[metric](F.col("embedding"), vector_literal(query))
    return vectors.withColumn("distance", distance).orderBy("distance", id_col).limit(k)


def vector_of(vectors: DataFrame, vec_id: int, id_col: str = "vec_id") -> list[float]:
    """One stored vector."""
    row = vectors.where(F.col(id_col) == vec_id).select("embedding").first()
    if row is None:
        raise ValueError(f"no vector {vec_id}")
    return list(row["embedding"])


def _distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of v to the same row of q, as l2() adds it up."""
    total = np.zeros(len(v))
    for x, y in zip(v.T, q.T, strict=True):
        total += (x - y) * (x - y)
    return np.sqrt(total)


def nearest_rows(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, id and distance of the k first rows by (distance, id) for each query, among these vectors and what is held of others."""
    at, best_ids, best = held or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    limit = np.full(len(queries), np.inf)
    place = np.arange(len(at)) - np.searchsorted(at, at)
    limit[at[place == k - 1]] = np.where(np.isnan(best[place == k - 1]), np.inf, best[place == k - 1])
    size = (queries**2).sum(1)
    for start in range(0, len(ids), BLOCK):
        own, v = ids[start : start + BLOCK], vectors[start : start + BLOCK]
        norm = (v**2).sum(1)
        square = size[:, None] - 2 * queries @ v.T + norm[None]
        # what rounding can change in this square, in that of l2() and by its root
        error = np.finfo(float).eps * (4 * v.shape[1] + 16) * (np.sqrt(size)[:, None] + np.sqrt(norm)[None]) ** 2
        most = limit**2 * (1 + 1e-12)
        if len(own) > k:
            most = np.fmin(most, np.partition(square + error, k - 1, axis=1)[:, k - 1])
        # not "<=": a distance that is no number stays, and comes last
        i, j = np.nonzero(~(square - error > most[:, None]))
        exact = np.concatenate([_distances(v[j[c : c + 65536]], queries[i[c : c + 65536]]) for c in range(0, len(j), 65536)] or [best[:0]])
        at, best_ids, best = np.concatenate([at, i]), np.concatenate([best_ids, own[j]]), np.concatenate([best, exact])
        order = np.lexsort((best_ids, best, at))
        at, best_ids, best = at[order], best_ids[order], best[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last = place == k - 1
        limit[at[last]] = np.where(np.isnan(best[last]), np.inf, best[last])
        at, best_ids, best = at[place < k], best_ids[place < k], best[place < k]
    return at, best_ids, best


def _nearest(queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                held = nearest_rows(queries, np.array(part.column(0).to_pylist(), np.int64), np.array(part.column(1).to_pylist(), np.float64), k, held)
        at, ids, best = held or nearest_rows(queries, np.zeros(0, np.int64), queries[:0], k)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids), pa.array(best)], ["asked", "vec_id", "distance"])

    return run


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest vectors of every query (vec_id, embedding), ties by vec_id. A few queries are sent to every task; more of them, whose ids have to differ, stay a table and meet blocks of vectors (see cells.py)."""
    spark = vectors.sparkSession
    stored = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    held = queries.select("vec_id", "embedding").limit(QUERIES_AT_ONCE + 1).collect()
    if not held:
        return stored.select(F.lit(0).cast("long").alias("query_id"), "vec_id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    if len(held) > QUERIES_AT_ONCE:
        from lectern.operators.cells import knn_cells

        return knn_cells(stored, queries, k)[0]
    near = stored.mapInArrow(_nearest(np.array([list(r["embedding"]) for r in held], float), k), "asked long, vec_id long, distance double")
    names = spark.createDataFrame([(i, int(r["vec_id"])) for i, r in enumerate(held)], "asked long, query_id long")
    order = Window.partitionBy("asked").orderBy("distance", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "asked").select("query_id", "vec_id", "distance", "rank")  # QUERIES_AT_ONCE rows at most


def register(spark: SparkSession, vectors_view: str = "vectors", id_col: str = "vec_id") -> None:
    """SQL names: l2_distance, cosine_distance, and the table function knn(q, k) over a view of vectors."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1 - dot_product(a, b) / sqrt(dot_product(a, a) * dot_product(b, b))")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION knn(q ARRAY<DOUBLE>, k INT) RETURNS TABLE({id_col} BIGINT, distance DOUBLE) RETURN"
        f" SELECT {id_col}, distance FROM (SELECT {id_col}, distance, row_number() OVER (ORDER BY distance, {id_col}) AS rn FROM (SELECT {id_col}, l2_distance(CAST(embedding AS ARRAY<DOUBLE>), q) AS distance FROM {vectors_view})) WHERE rn <= k"
    )


def overlap_score(query: Column, text: Column) -> Column:
    """A lexical score: the share of the query's distinct lower-cased words that the text has (0.0 without any)."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), ""))
    q = words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(F.lit(0.0))


def search_rerank(vectors: DataFrame, documents: DataFrame, query: list[float], query_text: str, candidates: int = 30, limit: int = 10, scorer=None) -> DataFrame:
    """The nearest candidates joined with their documents, scored against the query's text, best first."""
    near = knn(vectors, query, candidates).select("vec_id", "distance")
    rows = documents.join(F.broadcast(near), documents["doc_id"] == near["vec_id"])  # `candidates` rows
    score = (scorer or overlap_score)(F.lit(query_text), F.col("text"))
    return rows.withColumn("score", score).orderBy(F.desc("score"), "distance", "vec_id").limit(limit)
