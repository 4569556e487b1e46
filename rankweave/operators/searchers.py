"""Base searchers: a frame of queries in, ranked hits out."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embed import Embedder, embed
from ..functions.similarity import as_vector
from ..plans.queryset import QuerySet, as_queries
from ..plans.result import RankMetric, SearchResult
from .ivf import IvfIndex
from .keyword_index import KeywordIndex, bucket_of
from .knn import exact_knn
from .ranking import top_k
from .sizing import Size, broadcast_if, salted_join, scoring_tasks

# Scores are summed as integers of this fraction: the sum does not depend on
# the order in which tasks deliver their parts, so a retried task changes nothing.
SCORE_UNIT = 1e12


class BaseSearcher(ABC):
    @abstractmethod
    def search(self, queries: QuerySet | DataFrame | str) -> SearchResult: ...


class NullSearcher(BaseSearcher):
    """No hits, for tests."""

    def search(self, queries):
        df = as_queries(queries).df
        empty = df.select("query_id", F.lit(0).cast("bigint").alias("id"), F.lit(0.0).alias("score"))
        return SearchResult(empty.limit(0), RankMetric.UNDEFINED, bound=0, n_queries=0)


class BM25Searcher(BaseSearcher):
    """BM25 over every field of the index, summed.

    On an index with one field this scores whole documents.  ``max_count=None``
    keeps every match.  ``bag=True`` counts a repeated query word each time.
    """

    def __init__(
        self,
        index: KeywordIndex,
        max_count: int | None = None,
        *,
        bag: bool = False,
        k1: float = 1.2,
        b: float = 0.75,
        idf_base: float | None = None,
        digits: int = 6,
    ):
        self.index = index
        self.max_count = max_count
        self.bag = bag
        self.k1, self.b = k1, b
        self.idf_base = idf_base
        self.digits = digits

    def weights(self, index: KeywordIndex, terms: DataFrame, size: Size) -> DataFrame:
        """``(query_id, field, term, weight, avg_len)`` for the terms that occur."""
        fits = size.fits()
        seen = index.term_stats
        if not index.narrowed:
            asked, on = terms.select("term").distinct(), ["term"]
            if "bucket" in seen.columns:  # a stored index: buckets nobody asks for are pruned at run time
                asked, on = asked.withColumn("bucket", bucket_of(F.col("term"), index.buckets)), ["bucket", "term"]
            seen = seen.join(broadcast_if(asked.where(F.length("term") > 0), fits), on, "left_semi")
        counts = seen.groupBy("field", "term").agg(F.sum("df").alias("df"))
        if fits:
            known = F.broadcast(terms).join(counts, "term")
        else:
            # A common word may be in a third of the queries.
            known = salted_join(terms, counts, ["term"], F.col("query_id"))
        known = known.withColumn("sums", F.element_at(index.totals(), F.col("field")))
        n, df = F.col("sums.n"), F.col("df")
        ratio = 1 + (n - df + 0.5) / (df + 0.5)
        idf = F.ln(ratio) if self.idf_base is None else F.ln(ratio) / F.ln(F.lit(float(self.idf_base)))
        times = F.col("qtf") if self.bag else F.lit(1)
        return known.select(
            "query_id",
            "field",
            "term",
            (idf * (self.k1 + 1) * times).alias("weight"),
            (F.col("sums.total_len") / n).alias("avg_len"),
        )

    def search(self, queries):
        queries = as_queries(queries)
        terms, size = queries.terms(self.index.analyzer, self.index.stop_words)
        index = self.index.for_terms(terms, size, queries.count)
        weights = self.weights(index, terms, size)
        n_fields = len(index.fields)
        if Size(size.rows * n_fields, size.bytes * n_fields).fits():
            matches = self.spread(index, terms, queries.count).join(F.broadcast(weights), ["field", "term"])
        else:
            matches = self._salted(index, weights)
        damp = F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avg_len"))
        part = F.rint(F.col("weight") * F.col("tf") / damp * SCORE_UNIT).cast("bigint")
        scored = matches.groupBy("query_id", "id").agg(F.sum(part).alias("units"))
        step = 10.0**self.digits
        score = F.rint(F.col("units") / (SCORE_UNIT / step)) / step
        hits = scored.select("query_id", "id", score.alias("score"))
        if self.max_count is not None:
            order = [F.col("score").desc(), F.col("id").asc()]
            hits = top_k(hits, self.max_count, order)
        # A list without a limit has about as many rows as there are pairs to score.
        many = self.max_count is None and index.documents is not None
        return SearchResult(
            hits,
            RankMetric.SCORE,
            bound=queries.hits_bound(self.max_count),
            n_queries=queries.count,
            tasks=scoring_tasks(index.documents, queries.count) if many else None,
        )

    def spread(self, index: KeywordIndex, terms: DataFrame, queries: int) -> DataFrame:
        """The postings of the query terms, with every document in one task.

        A posting is shuffled once, however many queries ask for its term, and
        the sum per query and document needs no further shuffle.  The number of
        tasks follows from the documents and queries, so a task holds no more
        sums when either grows.
        """
        if index.narrowed:
            return index.postings
        # No token is empty; a filtered side lets Spark prune the buckets at run time.
        wanted = terms.filter(F.length("term") > 0).select("term").distinct()
        wanted = wanted.withColumn("bucket", bucket_of(F.col("term"), index.buckets))
        found = index.postings.join(F.broadcast(wanted), ["bucket", "term"], "left_semi")
        if index.documents is None:
            return found.repartition("id")
        return found.repartition(scoring_tasks(index.documents, queries), "id")

    def _salted(self, index: KeywordIndex, weights: DataFrame) -> DataFrame:
        """More query terms than a broadcast holds: join by term, splitting hot ones."""
        hot = F.broadcast(index.hot_terms())
        salts = F.coalesce("salts", F.lit(1))
        on = ["field", "term"]
        split = index.postings.join(hot, on, "left").withColumn(
            "salt", F.pmod(F.xxhash64("id"), salts).cast("int")
        )
        copies = weights.join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        return split.drop("salts").join(copies.drop("salts"), [*on, "salt"])


class FieldBM25Searcher(BM25Searcher):
    """BM25 per field and the sum over fields, always cut to ``max_count``."""

    def __init__(self, index: KeywordIndex, max_count: int, **options):
        super().__init__(index, max_count, bag=True, **options)


class VectorSearcher(BaseSearcher):
    """Nearest vectors of one model by cosine.

    Without an index every vector is compared and hits carry a similarity
    ``score``; with one, only the nearest cells are, and hits carry a
    ``distance``.  Queries bring a ``vec`` column or are embedded.
    """

    def __init__(
        self,
        vectors: DataFrame,
        *,
        model_name: str,
        max_count: int,
        embedder: Embedder | None = None,
        use_index: bool = False,
        index: IvfIndex | None = None,
        nprobe: int = 32,
        digits: int = 6,
        dimension: int | None = None,
    ):
        if use_index and index is None:
            raise ValueError("use_index needs an index")
        mine = vectors.filter(F.col("model_name") == model_name)
        if dimension is None:
            sample = mine.select(F.size("vec").alias("d")).first()
            if sample is None:
                raise ValueError(f"no vectors for model {model_name!r}")
            dimension = sample.d
        self.dimension = dimension
        self.vectors = mine
        self.max_count = max_count
        self.embedder = embedder
        self.index = index if use_index else None
        self.nprobe = nprobe
        self.digits = digits

    @classmethod
    def by_name(cls, spark, root: str, model_name: str, *, max_count: int, **options) -> VectorSearcher:
        """The searcher of a model from the registry at ``root``; KeyError for an unknown name."""
        from ..sources.registry import lookup, model_vectors

        row = lookup(spark, root, model_name)
        return cls(model_vectors(spark, row), model_name=model_name, max_count=max_count, dimension=row.dimension, **options)

    def search(self, queries):
        queries = as_queries(queries)
        if "vec" in queries.df.columns:
            vec = F.col("vec")
        elif self.embedder is not None:
            vec = embed(F.col("query"), self.embedder, is_query=True)
        else:
            raise ValueError("queries have no vectors and there is no embedder")
        asked = queries.df.select("query_id", as_vector(vec, self.dimension).alias("vec"))
        known = QuerySet(asked, queries.count)
        if self.index is not None:
            hits = self.index.search(known, self.max_count, self.nprobe, self.digits)
            metric = RankMetric.DISTANCE
        else:
            hits = exact_knn(self.vectors, known, self.max_count, self.dimension, digits=self.digits)
            metric = RankMetric.SCORE
        return SearchResult(
            hits, metric, bound=queries.hits_bound(self.max_count), n_queries=queries.count
        )
