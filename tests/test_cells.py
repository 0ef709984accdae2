"""Neighbours by cells: the same as a full comparison."""

import random

import numpy as np
import pytest

from lectern.operators import cells, vector


def rows(spark, found):
    return sorted(tuple(r) for r in found.select("query_id", "vec_id", "distance", "rank").collect())


def clustered(n, dim, clusters, seed, copies=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, dim)) * 10
    v = middle[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim))
    v[:copies] = v[0]  # ties
    return v.astype(np.float32)


@pytest.mark.parametrize(("k", "n_cells", "block", "copies"), [(1, 8, 4096, 0), (5, 16, 7, 0), (10, 4, 13, 60), (30, 64, 4096, 40), (400, 8, 50, 10)])
def test_same_as_a_full_comparison(spark, monkeypatch, k, n_cells, block, copies):
    monkeypatch.setattr(cells, "BLOCK", block)
    v = clustered(300, 6, 7, k, copies)
    e = spark.createDataFrame([(i * 3 % 307, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    q = e.where("vec_id % 4 = 0")
    found, share = cells.knn_cells(e, q, k, n_cells)
    assert rows(spark, found) == rows(spark, vector.knn_batch(e, q, k))
    assert 0 < share <= 1


def test_most_cells_are_ruled_out_where_vectors_are_clustered(spark):
    v = clustered(4000, 8, 40, 3)
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    q = e.where("vec_id % 20 = 0")
    found, share = cells.knn_cells(e, q, 10, 40)
    assert rows(spark, found) == rows(spark, vector.knn_batch(e, q, 10)) and share < 0.2


def test_queries_that_are_no_rows_and_empty_tables(spark):
    rng = random.Random(2)
    e = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(50)] + [(99, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(1000 + i, [rng.random() * 3 for _ in range(4)]) for i in range(5)], "vec_id long, embedding array<double>")
    found, _ = cells.knn_cells(e, q, 3, 8)
    assert rows(spark, found) == rows(spark, vector.knn_batch(e.where("vec_id <> 99"), q, 3))
    assert cells.knn_cells(e.limit(0), q, 3)[0].count() == 0 and cells.knn_cells(e, q.limit(0), 3)[0].count() == 0


def test_an_index_serves_many_queries(spark):
    v = clustered(200, 5, 4, 9)
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    index = cells.build(e, 10)
    assert index.rows.count() == 200 and index.counts.sum() == 200
    for q in (e.where("vec_id < 7"), e.where("vec_id > 180")):
        assert rows(spark, cells.knn_cells(index, q, 4)[0]) == rows(spark, vector.knn_batch(e, q, 4))


def test_more_queries_than_a_task_takes(spark, monkeypatch):
    v = clustered(120, 5, 4, 9).tolist()
    v[7], v[60] = [float("nan")] * 5, [1.0, float("nan"), 0.0, 0.0, 0.0]
    e = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>")
    q = e.where("vec_id % 5 IN (0, 2)")
    want = [(a, b, str(c), d) for a, b, c, d in rows(spark, vector.knn_batch(e, q, 119))]
    monkeypatch.setattr(vector, "QUERIES_AT_ONCE", 3)
    assert sorted(want) == sorted((a, b, str(c), d) for a, b, c, d in rows(spark, vector.knn_batch(e, q, 119)))
