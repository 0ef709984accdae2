"""Exact nearest neighbours of many queries by cells that the triangle inequality rules out.

Every vector belongs to the cell of its nearest centre; centres are fitted on a bounded sample, and every row is indexed. A
query is compared with its nearest cells first, as many as hold k vectors together. The k-th distance that they give
rules out each cell whose centre is further away than that distance and the cell's radius together: nothing in it can be among the k
first. The other cells are compared too, so the answer is that of a full comparison, ties by id included.

Vectors and queries stay tables. What meets is a block of a cell's vectors and a block of the queries that it has not been ruled
out for; both have a bounded size, so a cell that holds a third of all rows is as many tasks as it needs. Only centres and
one row for each cell reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.vector import nearest_rows
from lectern.scratch import cut

CELLS = 256
#: Vectors that centres are fitted on, and rounds of the fit.
SAMPLE, ROUNDS = 16_384, 4
#: Vectors, and queries, of a block.
BLOCK = 4096
#: A cell is ruled out only beyond what rounding can do to a distance.
SLACK = 1e-9


@dataclass
class Cells:
    """An index: rows (cell, block, vec_id, embedding), and of each cell its centre, radius, and numbers of rows and blocks."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.counts // BLOCK)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64).reshape(len(rows), -1)


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (v**2).sum(1)[:, None] - 2 * v @ centres.T + (centres**2).sum(1)[None]
    return np.sqrt(np.maximum(square, 0))


def _fitted(v: np.ndarray, cells: int) -> np.ndarray:
    """Centres: rows of the sample, moved to the middle of their cells a few times."""
    centres = v[:cells].copy()
    for _ in range(ROUNDS):
        own = _distances(v, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1)), centres)
            d[~np.isfinite(d)] = np.inf  # a vector of no numbers makes its cell one that is never ruled out
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own]), batch.column(0), batch.column(1)], ["cell", "away", "vec_id", "embedding"])

    return run


def build(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> Cells:
    """Of rows (vec_id, embedding), but for those without an embedding. Centres come from the rows with the smallest hashes."""
    rows = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not len(chosen):
        return Cells(rows.select(F.lit(0).alias("cell"), F.lit(0).cast("long").alias("block"), "vec_id", "embedding").limit(0), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64))
    known = _matrix(chosen["embedding"])
    fine = known[np.isfinite(known).all(axis=1)]
    centres = _fitted(fine, cells) if len(fine) else np.zeros((1, known.shape[1]))
    found = cut(rows.mapInArrow(_assigned(centres), "cell int, away double, vec_id long, embedding array<double>"), "cells")
    radii, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in found.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():  # a row for each cell
        radii[r["cell"]], counts[r["cell"]] = r["radius"], r["n"]
    sizes = F.array(*(F.lit(int(n)) for n in -(-counts // BLOCK)))
    placed = found.select("cell", F.pmod(F.xxhash64("vec_id"), F.get(sizes, F.col("cell")).cast("long")).alias("block"), "vec_id", "embedding")
    return Cells(placed, centres, radii, counts)


def _routes(index: Cells, k: int, rest: bool):
    """Queries with the cells that they are compared with: first the nearest that hold k rows, or the rest that the k-th distance does not rule out."""
    centres, radii, counts = index.centres, index.radii, index.counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1)), centres)
            d[~np.isfinite(d)] = -np.inf  # a query of no numbers meets all cells
            order = np.argsort(d, axis=1, kind="stable")
            before = np.cumsum(counts[order], axis=1) - counts[order]
            wanted = np.zeros(d.shape, bool)
            np.put_along_axis(wanted, order, before < k, axis=1)
            if rest:
                limit = np.array([np.inf if x is None or x != x else x for x in batch.column(2).to_pylist()])
                wanted = ~wanted & (d - radii[None] <= (limit * (1 + SLACK) + SLACK * (1 + np.abs(centres).max()))[:, None])
            wanted &= counts[None] > 0
            at, cell = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cell, pa.int32())], ["query_id", "asked", "cell"])

    return run


def _compared(index: Cells, routed: DataFrame, k: int) -> tuple[DataFrame, int]:
    """query_id, vec_id, distance: of each block that a query meets the k nearest rows; and how many pairs are compared."""
    asked = np.zeros(len(index.counts), np.int64)
    for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each cell
        asked[r["cell"]] = r["n"]
    of = lambda sizes: F.get(F.array(*(F.lit(int(n)) for n in sizes)), F.col("cell")).cast("long")
    parts, blocks = -(-asked // BLOCK), index.blocks
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    key = ["cell", "block", "part"]
    left = routed.withColumn("part", F.pmod(F.xxhash64("query_id"), of(parts))).withColumn("block", every(of(blocks))).select(*key, "query_id", "asked")
    right = index.rows.where(of(parts) > 0).withColumn("part", every(of(parts))).select(*key, "vec_id", "embedding")

    def near(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        at, ids, distance = nearest_rows(_matrix(queries["asked"]), np.array(vectors["vec_id"].to_pylist(), np.int64), _matrix(vectors["embedding"]), k) if len(queries) and len(vectors) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": queries["query_id"].take(pa.array(at)), "vec_id": pa.array(ids), "distance": pa.array(distance)})

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(near, "query_id long, vec_id long, distance double")
    return found, int((asked * index.counts).sum())


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_cells(vectors: DataFrame | Cells, queries: DataFrame, k: int, cells: int = CELLS) -> tuple[DataFrame, float]:
    """query_id, vec_id, distance, rank of the k nearest rows of every query (vec_id, embedding; ids that differ), ties by vec_id; and the share of all pairs that were compared."""
    index = vectors if isinstance(vectors, Cells) else build(vectors, cells)
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("asked"))
    if not len(index.counts):
        return asked.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0), 0.0
    schema = "query_id long, asked array<double>, cell int"
    near, compared = _compared(index, cut(asked.mapInArrow(_routes(index, k, False), schema), "routes"), k)
    near = cut(_first(near, k), "near")
    limit = near.where(F.col("rank") == k).select("query_id", F.col("distance").alias("limit"))
    bounded = asked.join(limit, "query_id", "left").select("query_id", "asked", "limit")
    more, further = _compared(index, cut(bounded.mapInArrow(_routes(index, k, True), schema), "routes"), k)
    total = asked.count() * int(index.counts.sum())
    return _first(near.drop("rank").unionByName(more), k), (compared + further) / max(1, total)
