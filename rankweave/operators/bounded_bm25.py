"""Top-k BM25 that skips blocks of documents which can't reach the k-th score.

Documents are dealt into ``BLOCKS`` blocks by a hash of their id.  Beside the index lies,
per (field, term, block), the largest term part ``tf / (tf + k1 (1 - b + b dl / avg_len))``
of its postings and their number.  A query's score of any document of a block is at most
the sum over its terms of ``weight x largest part``, its block bound.

Two passes, both Spark joins on (query, block):

1. each query scores exactly the documents of its best-bounded blocks, in order, until
   those blocks hold at least ``k`` matches and at least ``FIRST_BLOCKS`` are scored; the k-th of these real scores is a floor of the
   true k-th score;
2. each query keeps only the blocks whose bound reaches that floor, and in them only the
   documents that have a term the floor needs (MaxScore: the terms whose largest
   contributions, summed from the smallest, stay below the floor can't reach it alone);
   their top-k is the answer.

The postings of the query terms are shuffled once, by document, for both passes; bounds,
floors and needed terms are rows per query and block or term, and broadcast.

Scores are those of ``BM25Searcher`` to the last digit: the same weights, the same units and
the same rounding; bounds are compared with a slack that covers the rounding.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.queryset import as_queries
from ..plans.result import RankMetric, SearchResult
from ..sources.store import shared_dir
from .keyword_index import KeywordIndex
from .ranking import top_k
from .searchers import SCORE_UNIT, BM25Searcher
from .sizing import HIT_BYTES, Size, broadcast_if

BLOCKS = 256
# Pass 1 scores at least this many of a query's best-bounded blocks, for a higher floor.
FIRST_BLOCKS = 16
# Units are rounded per term and the score once more; this covers both for any query.
SLACK = 1e-5


def _order() -> list:
    return [F.col("score").desc(), F.col("id").asc()]


def _written(df: DataFrame, name: str) -> DataFrame:
    """A small table that several steps read, written to the shared folder and computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_of(id_column: str = "id") -> F.Column:
    return F.pmod(F.xxhash64(id_column), F.lit(BLOCKS)).cast("int")


def _avg_len(index: KeywordIndex) -> F.Column:
    sums = F.element_at(index.totals(), F.col("field"))
    return sums.getField("total_len") / sums.getField("n")


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by(["field", "term", "block"]).aggregate([("part", "max"), ("part", "count")])
        yield from found.select(["field", "term", "block", "part_max", "part_count"]).rename_columns(
            ["field", "term", "block", "top", "n"]
        ).combine_chunks().to_batches()


def block_maxima(index: KeywordIndex, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(field, term, block, top, n): the largest term part and the number of some postings of a block.

    A stored index lies sorted by term, so a batch of it holds few terms and is summed up where
    it is read; a block may have several rows, of which readers take the largest and the sum.
    """
    damp = F.col("tf") + k1 * (1 - b + b * F.col("dl") / _avg_len(index))
    parts = index.postings.select("field", "term", block_of().alias("block"), (F.col("tf") / damp).alias("part"))
    return parts.mapInArrow(_largest, "field string, term string, block int, top double, n long")


class BoundedBM25:
    """BM25 over every field, cut to ``max_count``, reading only blocks that can reach it."""

    def __init__(self, index: KeywordIndex, maxima: DataFrame, max_count: int, *, k1: float = 1.2, b: float = 0.75, digits: int = 6):
        self.index, self.maxima, self.k = index, maxima, max_count
        self.plain = BM25Searcher(index, max_count, k1=k1, b=b, digits=digits)
        self.k1, self.b, self.digits = k1, b, digits

    def _asked(self, queries):
        """Weights, and the postings of the query terms with every document in one task.

        Both passes read the same exchange; everything else they meet is a row per query and
        term or per query and block, so postings are shuffled once and only for words asked for.
        """
        terms, size = queries.terms(self.index.analyzer, self.index.stop_words)
        n_fields = len(self.index.fields)
        fits = Size(size.rows * n_fields, size.bytes * n_fields).fits()
        weights = _written(self.plain.weights(self.index, terms, size), "weights")
        if fits:
            postings = self.plain.spread(self.index, terms, queries.count)
        else:
            postings = self.index.postings
        postings = postings.select("field", "term", "id", "tf", "dl", block_of().alias("block"))
        return broadcast_if(weights, fits), postings, fits

    def _few(self, pairs: DataFrame, queries) -> DataFrame:
        """Rows of (query_id, block), broadcast if there can't be too many."""
        rows = queries.count * BLOCKS
        return broadcast_if(pairs, Size(rows, rows * HIT_BYTES).fits())

    def _units(self) -> F.Column:
        damp = F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avg_len"))
        return F.sum(F.rint(F.col("weight") * F.col("tf") / damp * SCORE_UNIT).cast("bigint"))

    def _score(self, units: DataFrame) -> DataFrame:
        step = 10.0**self.digits
        return units.select("query_id", "id", (F.rint(F.col("units") / (SCORE_UNIT / step)) / step).alias("score"))

    def _scored(self, weights: DataFrame, postings: DataFrame, blocks: DataFrame) -> DataFrame:
        """Exact (query_id, id, score) of the documents of the given (query_id, block) pairs."""
        matches = postings.join(weights, ["field", "term"]).join(blocks, ["query_id", "block"], "left_semi")
        return self._score(matches.groupBy("query_id", "id").agg(self._units().alias("units")))

    def _tops(self, weights: DataFrame, fits: bool) -> DataFrame:
        """(field, term, block, top, n) of the query terms, one row each."""
        asked = broadcast_if(weights.select("field", "term").distinct(), fits)
        mine = self.maxima.join(asked, ["field", "term"], "left_semi")
        return mine.groupBy("field", "term", "block").agg(F.max("top").alias("top"), F.sum("n").alias("n"))

    def _plan(self, queries):
        """Weights, largest parts, postings, the bound of every (query, block) pair, the kept pairs, and the floors."""
        weights, postings, fits = self._asked(queries)
        tops = _written(self._tops(weights, fits), "tops")
        bounds = tops.join(weights, ["field", "term"]).groupBy("query_id", "block").agg(
            F.sum(F.col("weight") * F.col("top")).alias("bound"), F.max("n").alias("least"), F.sum("n").alias("postings")
        )
        # Pass 1: the best-bounded blocks until they surely hold k matches.
        before = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block"))
        first = bounds.withColumn("before", F.coalesce(F.sum("least").over(before), F.lit(0))).withColumn("place", place)
        first = first.where((F.col("before") < self.k) | (F.col("place") <= FIRST_BLOCKS)).select("query_id", "block")
        floor = top_k(self._scored(weights, postings, self._few(first, queries)), self.k, _order()).groupBy("query_id").agg(
            F.when(F.count(F.lit(1)) >= self.k, F.min("score")).alias("floor")
        )
        kept = bounds.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
        return weights, tops, postings, fits, bounds, self._few(_written(kept, "blocks"), queries)

    def _needed(self, weights: DataFrame, tops: DataFrame, kept: DataFrame) -> DataFrame:
        """Weights with ``needed``: whether a term can't be left out.

        Terms of a query sorted by their largest contribution: those whose running sum stays
        below the floor can't lift a document to it even all together, so a document that has
        no other term of the query is dropped.
        """
        caps = tops.join(weights, ["field", "term"]).groupBy("query_id", "field", "term").agg(F.max(F.col("weight") * F.col("top")).alias("cap"))
        running = Window.partitionBy("query_id").orderBy("cap", "field", "term").rowsBetween(Window.unboundedPreceding, 0)
        floors = kept.select("query_id", "floor").distinct()
        needed = F.col("floor").isNull() | (F.col("sum") >= F.col("floor") - SLACK)
        marked = caps.withColumn("sum", F.sum("cap").over(running)).join(floors, "query_id", "left")
        return weights.join(marked.select("query_id", "field", "term", needed.alias("needed")), ["query_id", "field", "term"])

    def _scored_documents(self, weights: DataFrame, tops: DataFrame, postings: DataFrame, kept: DataFrame, fits: bool) -> DataFrame:
        """Exact (query_id, id, score, n) of documents of kept blocks that have a term which can't be left out."""
        marked = broadcast_if(self._needed(weights, tops, kept), fits)
        matches = postings.join(marked, ["field", "term"]).join(kept.select("query_id", "block"), ["query_id", "block"], "left_semi")
        units = matches.groupBy("query_id", "id").agg(
            self._units().alias("units"), F.max("needed").alias("needed"), F.count(F.lit(1)).alias("n")
        )
        return units.where("needed")

    def search(self, queries) -> SearchResult:
        """The top ``max_count`` per query, ties to the smaller id, as ``BM25Searcher`` gives them."""
        queries = as_queries(queries)
        weights, tops, postings, fits, _, kept = self._plan(queries)
        # Pass 2: documents of kept blocks that have a term which can't be left out.
        hits = top_k(self._score(self._scored_documents(weights, tops, postings, kept, fits)), self.k, _order())
        return SearchResult(hits, RankMetric.SCORE, bound=queries.hits_bound(self.k), n_queries=queries.count)

    def work(self, queries) -> dict:
        """Postings of the documents that pass 2 scores, against a search without bounds."""
        queries = as_queries(queries)
        weights, tops, postings, fits, bounds, kept = self._plan(queries)
        every = bounds.agg(F.count(F.lit(1)), F.sum("postings")).first()
        joined = self._scored_documents(weights, tops, postings, kept, fits).agg(F.sum("n")).first()[0] or 0
        return {"block_pairs": every[0], "block_pairs_kept": kept.count(), "postings": every[1], "postings_joined": joined}
