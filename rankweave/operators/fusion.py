"""Fusing the hits of several searchers."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.result import RankMetric, SearchResult
from .ranking import dense_ranks, dense_ranks_unbounded, top_k


def _total(parts: list[int | None]) -> int | None:
    return None if any(p is None for p in parts) else sum(parts)


def _queries(results: list[SearchResult]) -> int | None:
    known = [r.n_queries for r in results]
    return None if any(n is None for n in known) else max(known)


class FusionMethod(ABC):
    @abstractmethod
    def fuse(self, search_results: list[SearchResult]) -> SearchResult: ...


class ChainFusion(FusionMethod):
    """All hits once, with the number given by the first list that has the id.

    The numbers of different lists do not compare, so the metric is undefined;
    the order is list by list, best first within a list.
    """

    def fuse(self, search_results):
        def standard(position: int, result: SearchResult) -> DataFrame:
            # By position, as the name of the number depends on the metric.
            hits = result.df.select(*result.df.columns[:3]).toDF("query_id", "id", "score")
            sign = -1 if result.rank_metric is RankMetric.SCORE else 1
            score = F.col("score").cast("double")
            return hits.select(
                "query_id",
                F.col("id").cast("bigint").alias("id"),
                F.struct(F.lit(position).alias("source"), (score * sign).alias("place"), score.alias("score")).alias("hit"),
            )

        lists = [standard(i, r) for i, r in enumerate(search_results)]
        first = reduce(DataFrame.unionByName, lists).groupBy("query_id", "id").agg(F.min("hit").alias("hit"))
        return SearchResult(
            first.select("query_id", "id", F.col("hit.score").alias("score"), "hit.source", "hit.place"),
            RankMetric.UNDEFINED,
            bound=_total([r.bound for r in search_results]),
            n_queries=_queries(search_results),
            order=[F.col("source").asc(), F.col("place").asc()],
        )


class ReciprocalRankFusion(FusionMethod):
    """Sum of ``1 / (k + rank)`` over the lists, with dense ranks.

    ``mode="inverse_sum"`` gives ``1 / sum(k + rank)`` instead, which ranks an
    id lower for every further list it is in.
    """

    def __init__(self, k: int = 60, max_count: int | None = None, *, mode: str = "sum_inverse", digits: int = 9):
        if mode not in ("sum_inverse", "inverse_sum"):
            raise ValueError(f"unknown mode: {mode!r}")
        self.k = k
        self.max_count = max_count
        self.mode = mode
        self.digits = digits

    def fuse(self, search_results):
        def ranks(result: SearchResult) -> DataFrame:
            # A hit without a number has no place in the list, however long that is.
            scored = result.df.drop("rank").where(F.col(result.col()).isNotNull())
            if result.is_small():
                ranked = dense_ranks(scored, result.col(), result.descending())
            else:
                ranked = dense_ranks_unbounded(scored, result.col(), result.descending(), tasks=result.tasks)
            return ranked.select("query_id", "id", "rank")

        # A list without a metric has no order to rank by; an empty one adds nothing.
        lists = [ranks(r) for r in search_results if r.bound != 0]
        n_queries = _queries(search_results)
        if not lists:
            empty = search_results[0].df.select("query_id", "id", F.lit(0.0).alias("score"))
            return SearchResult(empty, RankMetric.SCORE, bound=0, n_queries=n_queries)
        place = F.col("rank") + self.k
        total = F.sum(1.0 / place) if self.mode == "sum_inverse" else 1.0 / F.sum(place)
        every = reduce(DataFrame.unionByName, lists)
        tasks = max((r.tasks or 0 for r in search_results), default=0)
        if tasks:  # a long list: no task sums up more than its share
            every = every.repartition(tasks, "query_id", "id")
        fused = every.groupBy("query_id", "id").agg(F.round(total, self.digits).alias("score"))
        bound = _total([r.bound for r in search_results])
        if self.max_count is not None:
            fused = top_k(fused, self.max_count, [F.col("score").desc(), F.col("id").asc()])
            if n_queries is not None:
                cut = n_queries * self.max_count
                bound = cut if bound is None else min(bound, cut)
        return SearchResult(fused, RankMetric.SCORE, bound=bound, n_queries=n_queries)
