"""Top-k BM25 with block bounds: the plain searcher's answer from fewer joined postings."""

from __future__ import annotations

import random

from rankweave.operators.bounded_bm25 import BoundedBM25, block_maxima
from rankweave.operators.keyword_index import WHOLE, load_index, save_index
from rankweave.operators.searchers import BM25Searcher
from rankweave.plans.queryset import as_queries


def corpus(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(20)]
    rare = [f"r{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = [rnd.choice(common) for _ in range(rnd.randint(5, 60))] + [rnd.choice(rare) for _ in range(rnd.randint(0, 3))]
        rows.append((i * 7, " ".join(words)))
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "r1 r1 r1")]
    return spark.createDataFrame(rows, "id long, doc string")


def test_same_hits_as_the_plain_searcher_with_fewer_rows(spark, tmp_path):
    docs = corpus(spark)
    save_index(docs, {WHOLE: "doc"}, str(tmp_path / "index"), buckets=4)
    index = load_index(spark, str(tmp_path / "index"))
    maxima = block_maxima(index)
    queries = spark.createDataFrame(
        [(1, "r1 c1 c2 c3"), (2, "r5 r9 c4"), (3, "c1 c2"), (4, "nothing here"), (5, ""), (6, "r1 r1 c1")], "query_id long, query string"
    )
    asked = as_queries(queries)
    for k in (1, 10, 50):
        plain = sorted(tuple(r) for r in BM25Searcher(index, k).search(asked).ranked(k).collect())
        bounded = sorted(tuple(r) for r in BoundedBM25(index, maxima, k).search(asked).ranked(k).collect())
        assert bounded == plain
    # A rare word beside common ones: documents without the rare word can't reach the 10th score.
    work = BoundedBM25(index, maxima, 10).work(as_queries(queries.where("query_id in (1, 2, 6)")))
    assert work["postings_joined"] < 0.5 * work["postings"]


def test_postings_are_shuffled_once_by_document(spark, tmp_path):
    """No plan of the search deals postings out by query or joins pairs of queries and documents."""
    docs = corpus(spark)
    save_index(docs, {WHOLE: "doc"}, str(tmp_path / "index"), buckets=4)
    index = load_index(spark, str(tmp_path / "index"))
    block_maxima(index).write.parquet(str(tmp_path / "maxima"))
    queries = spark.createDataFrame([(1, "r1 c1 c2 c3"), (2, "r5 r9 c4")], "query_id long, query string")
    hits = BoundedBM25(index, spark.read.parquet(str(tmp_path / "maxima")), 10).search(queries)
    plan = hits.df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert sum("REPARTITION_BY_NUM" in line for line in lines) == 1
    assert not [line for line in lines if "SortMergeJoin" in line and " id#" in line.replace("[", " ").replace("(", " ")]
    assert not [line for line in lines if "Exchange hashpartitioning(query_id" in line and ("block#" in line or " id#" in line)]
