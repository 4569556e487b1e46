"""Rerankers: fresh scores for the hits of the stage before.

Rerankers see only the documents of the hits.  Pairs are scored where the join
leaves them, by a column expression or in Arrow batches.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..plans.queryset import QuerySet, as_queries
from ..plans.result import RankMetric, SearchResult
from .knn import vector_matrix
from .ranking import top_k
from .sizing import measure, salted_join

PairScorer = Callable[[Column, Column], Column]
TABLE_BYTES = 64 << 20


def term_overlap(query_tokens: Column, doc_tokens: Column) -> Column:
    """Share of the distinct query tokens that the document has."""
    asked = F.array_distinct(query_tokens)
    shared = F.size(F.array_intersect(asked, doc_tokens))
    return F.when(F.size(asked) > 0, shared / F.size(asked)).otherwise(0.0)


def overlap_scorer(max_tokens: int | None = None, *, truncate: bool = False) -> PairScorer:
    """Term overlap of two texts; ``max_tokens`` is the input size of the model.

    A longer document counts by its best block of that size, or with ``truncate`` by its first;
    blocks don't overlap, so a passage over an edge is split.
    """

    def score(query: Column, doc: Column) -> Column:
        asked, tokens = tokenize(query), tokenize(doc)
        if max_tokens is None:
            return term_overlap(asked, tokens)
        if truncate:
            return term_overlap(asked, F.slice(tokens, 1, max_tokens))
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(max_tokens))
        return F.array_max(F.transform(starts, lambda i: term_overlap(asked, F.slice(tokens, i, F.lit(max_tokens)))))

    return score


def batch_scorer(load: Callable[[], Callable[[list[str], list[str]], np.ndarray]]) -> PairScorer:
    """A scorer from a model: ``load`` runs once per task, its result per batch."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, docs in batches:
            yield pd.Series(np.asarray(model(queries.tolist(), docs.tolist()), dtype="float64"))

    return run


class Reranker(ABC):
    documents: DataFrame

    @abstractmethod
    def rerank(self, queries: QuerySet | DataFrame | str, search_result: SearchResult) -> SearchResult: ...

    def retrieve_docs(self, search_result: SearchResult) -> DataFrame:
        """``(query_id, id, doc)`` for the hits that have a document."""
        pairs = SearchResult(
            search_result.df.select("query_id", "id"),
            search_result.rank_metric,
            bound=search_result.bound,
            n_queries=search_result.n_queries,
        )
        return pairs.fetch(self.documents).select("query_id", "id", "doc")

    def pairs(self, queries: QuerySet, search_result: SearchResult) -> DataFrame:
        """``(query_id, id, query, doc)``, spread evenly for the scoring to come."""
        docs = self.retrieve_docs(search_result)
        asked = queries.df.select("query_id", "query")
        if measure(asked, F.octet_length("query")).fits():
            return docs.repartition("query_id", "id").join(F.broadcast(asked), "query_id")
        # One query may own a third of the hits.
        return salted_join(docs, asked, ["query_id"], F.col("id"))


class PairReranker(Reranker):
    """Score every (query, document) pair; all hits stay unless ``max_count`` is set."""

    def __init__(self, documents: DataFrame, scorer: PairScorer | None = None, *, max_count: int | None = None, digits: int = 6):
        self.documents = documents
        self.scorer = scorer or overlap_scorer()
        self.max_count = max_count
        self.digits = digits

    def rerank(self, queries, search_result):
        queries = as_queries(queries)
        pairs = self.pairs(queries, search_result)
        score = F.round(self.scorer(F.col("query"), F.col("doc")), self.digits)
        scored = pairs.select("query_id", "id", score.alias("score"))
        return _cut(scored, self.max_count, search_result, queries)


class TruncatedPairReranker(PairReranker):
    """Pair scoring by a model that reads at most ``max_length`` document tokens at a time.

    All blocks of a document, which don't overlap, are scored and the best one counts; ``truncate`` reads only
    the first.
    """

    def __init__(self, documents: DataFrame, *, max_length: int = 1024, truncate: bool = False, **options):
        super().__init__(documents, overlap_scorer(max_length, truncate=truncate), **options)
        self.max_length = max_length


class MaxSimReranker(Reranker):
    """Late interaction: best match per query token, summed over the query.

    ``token_vectors(key, vec)`` maps tokens to vectors through ``token_key``; rows without a
    key or vector are left out, and of a repeated key the largest vector counts.
    A repeated document token cannot change a maximum, so documents send each
    key once and whole; a repeated query token counts each time.
    """

    def __init__(
        self,
        documents: DataFrame,
        token_vectors: DataFrame,
        dimension: int,
        *,
        max_count: int,
        token_key: Callable[[Column], Column] | None = None,
        digits: int = 6,
        table_bytes: int = TABLE_BYTES,
    ):
        self.documents = documents
        known = token_vectors.where(F.col("key").isNotNull() & F.col("vec").isNotNull())
        self.token_vectors = known.groupBy("key").agg(F.max("vec").alias("vec"))
        self.dimension = dimension
        self.max_count = max_count
        self.token_key = token_key or (lambda token: token)
        self.digits = digits
        self.table_bytes = table_bytes

    def rerank(self, queries, search_result):
        queries = as_queries(queries)
        keys = self.pairs(queries, search_result).select(
            "query_id",
            "id",
            F.transform(tokenize("query"), self.token_key).alias("asked"),
            F.array_distinct(F.transform(tokenize("doc"), self.token_key)).alias("given"),
        )
        size = measure(self.token_vectors)
        if size.rows * self.dimension * 8 <= self.table_bytes:
            scored = self._by_table(keys)
        else:
            scored = self._by_join(keys)
        scored = scored.withColumn("score", F.round("score", self.digits))
        return _cut(scored, self.max_count, search_result, queries)

    def _by_table(self, keys: DataFrame) -> DataFrame:
        """The token table travels to the tasks once; pairs stay where they are."""
        table = self.token_vectors.select("key", "vec").toArrow().combine_chunks()
        matrix = vector_matrix(table["vec"], self.dimension)
        shared = keys.sparkSession.sparkContext.broadcast((table["key"].combine_chunks(), matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, matrix = shared.value
            for batch in batches:
                asked = known_rows(batch.column("asked"), known)
                given = known_rows(batch.column("given"), known)
                scores = [max_sim(matrix[q], matrix[d]) for q, d in zip(asked, given)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), batch.column("id"), pa.array(scores, pa.float64())],
                    ["query_id", "id", "score"],
                )

        return keys.mapInArrow(run, "query_id bigint, id bigint, score double")

    def _by_join(self, keys: DataFrame) -> DataFrame:
        """A token table too large to send: join it, then meet again per pair."""
        sides = keys.select(
            "query_id",
            "id",
            F.explode(
                F.concat(
                    F.transform("asked", lambda k: F.struct(F.lit(True).alias("is_query"), k.alias("key"))),
                    F.transform("given", lambda k: F.struct(F.lit(False).alias("is_query"), k.alias("key"))),
                )
            ).alias("token"),
        ).select("query_id", "id", "token.is_query", "token.key")
        # Common words are in most pairs.
        found = salted_join(sides, self.token_vectors.select("key", "vec"), ["key"], F.struct("query_id", "id"))
        dimension = self.dimension

        def run(pair: pa.Table) -> pa.Table:
            vecs = vector_matrix(pair["vec"], dimension)
            is_query = pair["is_query"].to_numpy().astype(bool)
            score = max_sim(vecs[is_query], vecs[~is_query])
            return pa.table(
                {"query_id": pair["query_id"][:1], "id": pair["id"][:1], "score": pa.array([score], pa.float64())}
            )

        # A group is the words of one query and one document.
        scored = found.groupBy("query_id", "id").applyInArrow(run, "query_id bigint, id bigint, score double")
        pairs = keys.select("query_id", "id").join(scored, ["query_id", "id"], "left")
        return pairs.withColumn("score", F.coalesce("score", F.lit(0.0)))


def known_rows(lists: pa.ListArray, known: pa.Array) -> list[np.ndarray]:
    """Per list, the positions in ``known`` of those elements it has."""
    found = pc.index_in(lists.flatten(), value_set=known)
    at = found.fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return [part[part >= 0] for part in np.split(at, ends[:-1])]


def max_sim(asked: np.ndarray, given: np.ndarray) -> float:
    if not len(asked) or not len(given):
        return 0.0
    return float((asked @ given.T).max(axis=1).sum())


def _cut(scored: DataFrame, max_count: int | None, before: SearchResult, queries: QuerySet) -> SearchResult:
    bound = before.bound
    if max_count is not None:
        scored = top_k(scored, max_count, [F.col("score").desc(), F.col("id").asc()])
        cut = queries.count * max_count
        bound = cut if bound is None else min(bound, cut)
    return SearchResult(scored, RankMetric.SCORE, bound=bound, n_queries=queries.count)
