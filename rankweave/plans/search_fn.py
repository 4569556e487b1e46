"""Putting searchers, a fusion and a reranker together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.fusion import FusionMethod
from ..operators.rerank import Reranker
from ..operators.searchers import BaseSearcher
from .queryset import QuerySet, as_queries
from .result import SearchResult


def create_search_fn(
    base_searchers: BaseSearcher | list[BaseSearcher],
    *,
    fusion_method: FusionMethod | None = None,
    reranker: Reranker | None = None,
) -> Callable[[QuerySet | DataFrame | str], SearchResult]:
    """A function from queries, or one query text, to a lazy result.

    Two searchers or more need a fusion method; one must not have any.
    """
    searchers = [base_searchers] if isinstance(base_searchers, BaseSearcher) else list(base_searchers)
    if not searchers:
        raise ValueError("at least one base searcher is needed")
    if len(searchers) == 1 and fusion_method is not None:
        raise ValueError("a fusion method needs two base searchers or more")
    if len(searchers) > 1 and fusion_method is None:
        raise ValueError("two base searchers or more need a fusion method")

    def search(queries: QuerySet | DataFrame | str) -> SearchResult:
        asked = as_queries(queries)
        results = [s.search(asked) for s in searchers]
        found = results[0] if fusion_method is None else fusion_method.fuse(results)
        return found if reranker is None else reranker.rerank(asked, found)

    return search
