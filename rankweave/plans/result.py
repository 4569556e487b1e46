"""What every searcher, fusion and reranker returns, and how it meets the rows."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_k
from ..operators.sizing import BROADCAST_BYTES, HIT_BYTES, broadcast_if, salted_join
from ..sources.store import block_of, block_width


LOWEST_ID = -(1 << 63)


def fetch_rows(hits: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """Join hits with a table keyed by ``id``; ``small`` hits are broadcast.

    A table written in id blocks is pruned at run time, since the block of
    each hit then joins the partition column.
    """
    on, width = ["id"], block_width(table)
    if width is not None:
        # The filter keeps every hit; run-time pruning wants a filtered side.
        hits = hits.withColumn("id_block", block_of(width)).filter(F.col("id") >= LOWEST_ID)
        on = ["id", "id_block"]
    return table.join(broadcast_if(hits, small), on).drop("id_block")


class RankMetric(Enum):
    SCORE = 1
    DISTANCE = 2
    UNDEFINED = 3


class SearchResult:
    """Hits ``(query_id, id, score|distance)`` and the meaning of the number.

    Hits that were cut to the best of each query also carry their ``rank``.

    ``bound`` is an upper limit on the number of hits where one is known;
    it is what allows a join to broadcast them.  ``order`` replaces the
    metric's order where the metric is undefined.  ``tasks`` says over how many tasks
    a step should deal hits without a known limit.
    """

    def __init__(
        self,
        df: DataFrame,
        rank_metric: RankMetric,
        *,
        bound: int | None = None,
        n_queries: int | None = None,
        order: Sequence[Column] | None = None,
        tasks: int | None = None,
    ):
        self.df = df
        self.rank_metric = rank_metric
        self.bound = bound
        self.n_queries = n_queries
        self.tasks = tasks
        self._order = order

    def descending(self) -> bool:
        if self.rank_metric is RankMetric.UNDEFINED:
            raise ValueError(f"no direction for {self.rank_metric}")
        return self.rank_metric is RankMetric.SCORE

    def col(self) -> str:
        return {RankMetric.SCORE: "score", RankMetric.DISTANCE: "distance"}.get(self.rank_metric, "undefined_metric")

    def order_by(self) -> list[Column]:
        """Best first, ties by id."""
        if self._order is not None:
            return [*self._order, F.col("id").asc()]
        value = F.col(self.col())
        return [value.desc() if self.descending() else value.asc(), F.col("id").asc()]

    def is_small(self) -> bool:
        return self.bound is not None and self.bound * HIT_BYTES <= BROADCAST_BYTES

    def ranked(self, max_count: int) -> DataFrame:
        """The best ``max_count`` hits of every query with their ``rank``."""
        if "rank" in self.df.columns:
            return self.df.filter(F.col("rank") <= max_count)
        return top_k(self.df, max_count, self.order_by())

    def fetch(self, table: DataFrame) -> DataFrame:
        """Inner join of the hits with a table keyed by ``id``."""
        return fetch_rows(self.df.drop("rank"), table, self.is_small())

    def retrieve(self, entries: DataFrame, issues: DataFrame, max_count: int) -> DataFrame:
        """The rows of the best hits: ``query_id, rank, id, title, author, content, main_link, date``.

        Hits whose entry has no known issue do not count towards ``max_count``.
        """
        dated = issues.select(F.col("id").alias("issue_id"), F.col("publish_date").cast("string").alias("date"))
        keep = [c for c in ("id", "issue_id", "id_block") if c in entries.columns]
        if self.is_small():
            found = self.fetch(entries).join(dated, "issue_id")
            best = top_k(found, max_count, self.order_by())
        else:
            # Choose the winners on narrow columns; read text for them alone.
            narrow = self.fetch(entries.select(*keep))
            narrow = salted_join(narrow, dated, ["issue_id"], F.col("id"))
            winners = top_k(narrow, max_count, self.order_by())
            few = self.n_queries is not None and self.n_queries * max_count * HIT_BYTES <= BROADCAST_BYTES
            best = fetch_rows(winners.drop("issue_id"), entries.drop("issue_id"), few)
        return best.select(
            "query_id",
            "rank",
            "id",
            "title",
            "author",
            F.coalesce("content", F.lit("")).alias("content"),
            "main_link",
            "date",
        )


def in_order(results: DataFrame) -> DataFrame:
    """Sort retrieved rows for reading; the rank already says the order."""
    return results.orderBy("query_id", "rank")
