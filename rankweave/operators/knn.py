"""Exact nearest neighbours by cosine.

Every task multiplies its batches of vectors with the matrix of queries and
keeps a running top-k per query, so pairs of vector and query never become
rows: a task emits at most k rows per query, whatever it has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.queryset import QuerySet
from .ranking import top_k

HIT_SCHEMA = "query_id bigint, id bigint, {value} double"
# Queries travel to every task up to this size; beyond it both sides are blocked.
QUERY_BYTES = 64 << 20
# Rows of a block and queries of a block in that case.
BLOCK_VECTORS = 50_000
BLOCK_QUERIES = 5_000
# Cells of one product held in memory at a time.
PRODUCT_CELLS = 4_000_000


def vector_matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    """A list column as a matrix; rows of another length fail the task."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if len(flat) != len(column) * dimension:
        raise ValueError(f"vectors are not all of length {dimension}")
    return flat.reshape(len(column), dimension)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN and matches nothing."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


class Best:
    """Running top-k per query; lower keys are better, ties go to the lower id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.keys = [np.empty(0) for _ in range(n_queries)]
        self.ids = [np.empty(0, dtype="int64") for _ in range(n_queries)]
        self.cut = np.full(n_queries, np.inf)

    def offer(self, keys: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
        """``keys[i, j]`` is the key of ``ids[i]`` for query ``columns[j]``."""
        within = keys <= self.cut[columns]
        for j in np.flatnonzero(within.any(axis=0)):
            q, rows = columns[j], within[:, j]
            merged = np.concatenate([self.keys[q], keys[rows, j]])
            names = np.concatenate([self.ids[q], ids[rows]])
            if len(merged) > self.k:
                near = merged <= np.partition(merged, self.k - 1)[self.k - 1]
                merged, names = merged[near], names[near]
                first = np.lexsort((names, merged))[: self.k]
                merged, names = merged[first], names[first]
            self.keys[q], self.ids[q] = merged, names
            if len(merged) == self.k:
                self.cut[q] = merged.max()

    def rows(self, query_ids: np.ndarray, distance: bool) -> pa.RecordBatch:
        counts = [len(k) for k in self.keys]
        keys = np.concatenate([np.empty(0), *self.keys])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(query_ids, counts), pa.int64()),
                pa.array(np.concatenate([np.empty(0, "int64"), *self.ids]), pa.int64()),
                pa.array(keys if distance else 0.0 - keys, pa.float64()),
            ],
            ["query_id", "id", "distance" if distance else "score"],
        )


def offer_batch(
    best: Best, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, columns: np.ndarray, distance: bool, digits: int
) -> None:
    """Compare unit vectors with the unit queries at ``columns``."""
    step = max(1, PRODUCT_CELLS // max(1, len(vectors)))
    for start in range(0, len(columns), step):
        some = columns[start : start + step]
        cosine = vectors @ queries[some].T
        keys = np.round(1 - cosine, digits) + 0.0 if distance else 0.0 - np.round(cosine, digits)
        best.offer(np.where(np.isnan(keys), np.inf, keys), ids, some)


def drop_unmatched(best: Best) -> None:
    for q, keys in enumerate(best.keys):
        real = np.isfinite(keys)
        best.keys[q], best.ids[q] = keys[real], best.ids[q][real]


def exact_knn(
    vectors: DataFrame,
    queries: QuerySet,
    k: int,
    dimension: int,
    *,
    distance: bool = False,
    digits: int = 6,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``k`` nearest ids for every query, as ``(query_id, id, score|distance)``."""
    rows = vectors.filter(F.col("vec").isNotNull()).select("id", "vec")
    value = "distance" if distance else "score"
    if queries.count * dimension * 8 <= query_bytes:
        near = _scan(rows, queries, k, dimension, distance, digits)
    else:
        near = blocked_knn(
            rows.withColumn("cell", F.lit(0)),
            queries.df.withColumn("cells", F.array(F.lit(0))),
            queries.count,
            k,
            dimension,
            distance=distance,
            digits=digits,
        )
    order = [F.col(value).asc() if distance else F.col(value).desc(), F.col("id").asc()]
    return top_k(near, k, order)


def collect_queries(queries: QuerySet, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Query ids and unit vectors on the driver; callers have checked the size."""
    table = queries.df.select("query_id", "vec").filter(F.col("vec").isNotNull()).toArrow()
    ids = table["query_id"].to_numpy().astype("int64")
    return ids, unit_rows(vector_matrix(table["vec"], dimension))


def _scan(rows: DataFrame, queries: QuerySet, k: int, dimension: int, distance: bool, digits: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(collect_queries(queries, dimension))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        best = Best(len(query_ids), k)
        everyone = np.arange(len(query_ids))
        for batch in batches:
            vecs = unit_rows(vector_matrix(batch.column("vec"), dimension))
            offer_batch(best, vecs, batch.column("id").to_numpy(), matrix, everyone, distance, digits)
        drop_unmatched(best)
        yield best.rows(query_ids, distance)

    return rows.mapInArrow(run, HIT_SCHEMA.format(value="distance" if distance else "score"))


def blocked_knn(
    rows: DataFrame,
    queries: DataFrame,
    n_queries: int,
    k: int,
    dimension: int,
    *,
    distance: bool,
    digits: int,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Compare vectors ``(id, vec, cell)`` with the queries that name their cell.

    For more queries than a broadcast holds.  A cell is split into shards of
    about ``block_vectors`` rows, the queries into blocks; one task sees one
    shard and one block, and a crowded cell just has more shards.
    """
    n_blocks = -(-n_queries // block_queries)
    shards = rows.groupBy("cell").agg(F.ceil(F.count("*") / block_vectors).cast("int").alias("shards"))
    # One row per cell: as many as the index has centroids.
    shards = F.broadcast(shards)
    left = rows.join(shards, "cell").select(
        "id",
        "vec",
        "cell",
        F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
    )
    right = (
        queries.filter(F.col("vec").isNotNull())
        .select(
            "query_id",
            "vec",
            F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"),
            F.explode("cells").alias("cell"),
        )
        .join(shards, "cell")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .drop("shards")
    )

    def run(vecs: pa.Table, asks: pa.Table) -> pa.Table:
        query_ids = asks["query_id"].to_numpy()
        best = Best(len(query_ids), k)
        if len(vecs) and len(asks):
            offer_batch(
                best,
                unit_rows(vector_matrix(vecs["vec"], dimension)),
                vecs["id"].to_numpy(),
                unit_rows(vector_matrix(asks["vec"], dimension)),
                np.arange(len(query_ids)),
                distance,
                digits,
            )
        drop_unmatched(best)
        return pa.Table.from_batches([best.rows(query_ids, distance)])

    on = ["cell", "shard", "block"]
    schema = HIT_SCHEMA.format(value="distance" if distance else "score")
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)
