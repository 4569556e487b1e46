"""Hybrid document search on Spark: keyword, vector, fusion, rerank, retrieve."""

from .functions.embed import Embedder, HashingEmbedder, embed
from .operators.fusion import ChainFusion, FusionMethod, ReciprocalRankFusion
from .operators.ivf import IvfIndex, build_ivf, load_ivf
from .operators.keyword_index import KeywordIndex, append_index, derive_index, load_index, save_index
from .operators.rerank import (
    MaxSimReranker,
    PairReranker,
    Reranker,
    TruncatedPairReranker,
    batch_scorer,
    overlap_scorer,
)
from .operators.searchers import BaseSearcher, BM25Searcher, FieldBM25Searcher, NullSearcher, VectorSearcher
from .plans.queryset import QuerySet, as_queries
from .plans.result import RankMetric, SearchResult, in_order
from .plans.search_fn import create_search_fn

__all__ = [
    "BM25Searcher",
    "BaseSearcher",
    "ChainFusion",
    "Embedder",
    "FieldBM25Searcher",
    "FusionMethod",
    "HashingEmbedder",
    "IvfIndex",
    "KeywordIndex",
    "MaxSimReranker",
    "NullSearcher",
    "PairReranker",
    "QuerySet",
    "RankMetric",
    "ReciprocalRankFusion",
    "Reranker",
    "SearchResult",
    "TruncatedPairReranker",
    "VectorSearcher",
    "append_index",
    "as_queries",
    "batch_scorer",
    "build_ivf",
    "create_search_fn",
    "derive_index",
    "embed",
    "in_order",
    "load_index",
    "load_ivf",
    "overlap_scorer",
    "save_index",
]
