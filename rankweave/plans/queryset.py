"""Queries as a frame, with their number counted once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..operators.sizing import Size, measure


@dataclass(frozen=True)
class QuerySet:
    """``(query_id, query[, vec])`` and the number of rows."""

    df: DataFrame
    count: int
    _terms: dict = field(default_factory=dict, compare=False, repr=False)

    def terms(self, analyzer: str = "simple", stop_words: Sequence[str] | None = None) -> tuple[DataFrame, Size]:
        """The query terms and their size, measured once per analyzer."""
        key = (analyzer, None if stop_words is None else tuple(stop_words))
        if key not in self._terms:
            words = query_terms(self.df, analyzer, stop_words)
            self._terms[key] = (words, measure(words, F.octet_length("term")))
        return self._terms[key]

    def hits_bound(self, max_count: int | None) -> int | None:
        return None if max_count is None else self.count * max_count


def as_queries(queries: QuerySet | DataFrame | str) -> QuerySet:
    if isinstance(queries, QuerySet):
        return queries
    if isinstance(queries, str):
        spark = SparkSession.active()
        one = spark.range(1).select(F.col("id").alias("query_id"), F.lit(queries).alias("query"))
        return QuerySet(one, 1)
    return QuerySet(queries, queries.count())
