"""What a task holds does not grow with the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.operators import sizing
from rankweave.operators.keyword_index import WHOLE, derive_index, load_index, save_index
from rankweave.operators.ranking import dense_ranks_unbounded
from rankweave.operators.searchers import BM25Searcher


def corpus(spark):
    return spark.range(100).select("id", F.concat(F.lit("a b w"), F.col("id") % 7).alias("doc"))


def asked(spark):
    return spark.createDataFrame([(1, "a w3"), (2, "b"), (3, "w1 w2")], "query_id long, query string")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_tasks_follow_documents_and_queries(spark, monkeypatch):
    docs, queries = corpus(spark), asked(spark)
    plain = sorted(tuple(r) for r in BM25Searcher(derive_index(docs, {WHOLE: "doc"}), 5).search(queries).ranked(5).collect())
    monkeypatch.setattr(sizing, "PAIRS_PER_TASK", 20, raising=False)
    hits = BM25Searcher(derive_index(docs, {WHOLE: "doc"}), 5).search(queries).ranked(5)
    assert ", 15), REPARTITION_BY_NUM" in plan_of(hits)
    assert sorted(tuple(r) for r in hits.collect()) == plain


def test_a_stored_index_is_scored_by_as_many_tasks(spark, monkeypatch, tmp_path):
    save_index(corpus(spark), {WHOLE: "doc"}, str(tmp_path / "index"), buckets=2)
    monkeypatch.setattr(sizing, "PAIRS_PER_TASK", 20, raising=False)
    hits = BM25Searcher(load_index(spark, str(tmp_path / "index")), 5).search(asked(spark)).ranked(5)
    assert ", 15), REPARTITION_BY_NUM" in plan_of(hits)


def test_unbounded_ranks_copy_no_levels(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("query_id"), "id", (F.col("id") % 9 / 3.0).alias("score"))
    ranked = dense_ranks_unbounded(rows, "score", True)
    assert "Generate" not in plan_of(ranked)
    want = {s: i + 1 for i, s in enumerate(sorted({r.score for r in rows.collect()}, reverse=True))}
    assert all(r.rank == want[r.score] for r in ranked.collect())
