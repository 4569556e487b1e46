"""Approximate nearest neighbours: vectors grouped into k-means cells.

A query is compared with the vectors of its ``nprobe`` nearest cells only.  The
vectors lie on disk by cell, so the other cells are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.queryset import QuerySet
from .knn import HIT_SCHEMA, QUERY_BYTES, Best, blocked_knn, collect_queries, drop_unmatched, offer_batch
from .knn import unit_rows, vector_matrix
from .ranking import top_k

# Products of a slice of vectors with all cells that are held at once.
NEAREST_CELLS = 1 << 22


@dataclass(frozen=True)
class IvfIndex:
    """``vectors(id, vec, cell)`` and the centroids, one row per cell."""

    vectors: DataFrame
    centroids: np.ndarray

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    def nearest_cells(self, unit_queries: np.ndarray, nprobe: int) -> np.ndarray:
        return nearest(self.centroids, unit_queries, nprobe)

    def search(
        self, queries: QuerySet, k: int, nprobe: int, digits: int = 6, query_bytes: int = QUERY_BYTES
    ) -> DataFrame:
        """``(query_id, id, distance)``, the best ``k`` of the probed cells."""
        if queries.count * self.dimension * 8 <= query_bytes:
            near = self._scan(queries, k, nprobe, digits)
        else:
            near = blocked_knn(
                self.vectors,
                self._with_cells(queries.df, nprobe),
                queries.count,
                k,
                self.dimension,
                distance=True,
                digits=digits,
            )
        return top_k(near, k, [F.col("distance").asc(), F.col("id").asc()])

    def _scan(self, queries: QuerySet, k: int, nprobe: int, digits: int) -> DataFrame:
        query_ids, matrix = collect_queries(queries, self.dimension)
        cells = self.nearest_cells(matrix, nprobe)
        probed = sorted({int(c) for c in cells.ravel()})
        callers = {c: np.flatnonzero((cells == c).any(axis=1)) for c in probed}
        spark = self.vectors.sparkSession
        shared = spark.sparkContext.broadcast((query_ids, matrix, callers))
        dimension = self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, matrix, callers = shared.value
            best = Best(len(query_ids), k)
            for batch in batches:
                ids, where = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
                vecs = unit_rows(vector_matrix(batch.column("vec"), dimension))
                for cell in np.unique(where):
                    here = where == cell
                    offer_batch(best, vecs[here], ids[here], matrix, callers[int(cell)], True, digits)
            drop_unmatched(best)
            yield best.rows(query_ids, True)

        rows = self.vectors.select("id", "vec", "cell")
        if len(probed) < len(self.centroids):
            # At most one literal per cell; on a stored index this skips directories.
            rows = rows.filter(F.col("cell").isin(probed))
        return rows.mapInArrow(run, HIT_SCHEMA.format(value="distance"))

    def _with_cells(self, queries: DataFrame, nprobe: int) -> DataFrame:
        centroids, dimension = self.centroids, self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = nearest(centroids, unit_rows(vector_matrix(batch.column("vec"), dimension)), nprobe)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("vec"), pa.array(cells.tolist(), pa.list_(pa.int32()))],
                    ["query_id", "vec", "cells"],
                )

        asked = queries.select("query_id", "vec").filter(F.col("vec").isNotNull())
        return asked.mapInArrow(run, "query_id bigint, vec array<float>, cells array<int>")

    def save(self, path: str) -> None:
        """Vectors by cell; a crowded cell is spread over several files."""
        (
            self.vectors.repartitionByRange("cell", "id")
            .sortWithinPartitions("cell", "id")
            .write.mode("overwrite")
            .partitionBy("cell")
            .parquet(f"{path}/vectors")
        )
        spark = self.vectors.sparkSession
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        centroids = spark.createDataFrame(rows, "cell int, center array<double>")
        centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load_ivf(spark: SparkSession, path: str) -> IvfIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return IvfIndex(spark.read.parquet(f"{path}/vectors"), np.array([r.center for r in rows]))


def nearest(centroids: np.ndarray, unit_vectors: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` cells closest by cosine, closest first; compared slice by slice, to bound the memory."""
    n = min(n, len(centroids))
    out = np.empty((len(unit_vectors), n), np.int64)
    step = max(1, NEAREST_CELLS // max(1, len(centroids)))
    for at in range(0, len(unit_vectors), step):
        far = -(unit_vectors[at : at + step] @ centroids.T)
        if n == 1:
            out[at : at + step, 0] = far.argmin(axis=1)
            continue
        some = np.argpartition(far, n - 1, axis=1)[:, :n] if n < far.shape[1] else np.broadcast_to(np.arange(n), far.shape)
        some = np.sort(some, axis=1)
        order = np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable")
        out[at : at + step] = np.take_along_axis(some, order, axis=1)
    return out


def build_ivf(vectors: DataFrame, n_cells: int, *, seed: int = 42, max_iter: int = 10) -> IvfIndex:
    """Learn the cells from all vectors and assign every vector to its nearest one.

    Vectors without a direction (all zeros) match no query and get no cell.
    """
    some = F.exists("vec", lambda x: x != 0)
    rows = vectors.filter(F.col("vec").isNotNull() & some).select("id", "vec")
    trained = rows.select(array_to_vector("vec").alias("features"))
    means = KMeans(k=n_cells, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(trained)
    centroids = unit_rows(np.array(means.clusterCenters()))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            cells = nearest(centers, unit_rows(vector_matrix(batch.column("vec"), centers.shape[1])), 1)[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(cells, pa.int32())], ["id", "vec", "cell"]
            )

    return IvfIndex(rows.mapInArrow(assign, "id bigint, vec array<float>, cell int"), centroids)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, found, wanted)``: how many of the true neighbours were returned."""
    truth = exact.select("query_id", "id")
    both = truth.join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("wanted"))
