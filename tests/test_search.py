"""Searchers, fusion and rerankers on small frames and against brute force."""

from __future__ import annotations

import math
import re
import shutil

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankweave import (
    BM25Searcher,
    ChainFusion,
    FieldBM25Searcher,
    HashingEmbedder,
    MaxSimReranker,
    NullSearcher,
    PairReranker,
    RankMetric,
    ReciprocalRankFusion,
    SearchResult,
    TruncatedPairReranker,
    VectorSearcher,
    as_queries,
    batch_scorer,
    build_ivf,
    create_search_fn,
    derive_index,
    embed,
    load_index,
    load_ivf,
    save_index,
)
from rankweave.operators import knn, searchers
from rankweave.operators.keyword_index import append_index
from rankweave.operators.ranking import dense_ranks, dense_ranks_unbounded, top_k
from rankweave.operators.sizing import salted_join
from rankweave.plans.inputs import Inputs
from rankweave.plans.queries import keyword_hits, n_cells, vector_searcher
from rankweave.sources.store import write_blocks
from rankweave import schema

from .conftest import SF_DIR

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "the the the dog"),
    (3, "a fox and another fox met one Fox"),
    (4, ""),
    (5, None),
    (6, "Über-schnelle Füchse 42 springen"),
]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_bm25(docs, query, bag=False, k1=1.2, b=0.75):
    tokens = {i: words(t) for i, t in docs}
    n, total = len(docs), sum(map(len, tokens.values()))
    asked = words(query) if bag else set(words(query))
    scores = {}
    for term in asked:
        holders = [i for i, ws in tokens.items() if term in ws]
        idf = math.log(1 + (n - len(holders) + 0.5) / (len(holders) + 0.5))
        for i in holders:
            tf = tokens[i].count(term)
            damp = tf + k1 * (1 - b + b * len(tokens[i]) / (total / n))
            scores[i] = scores.get(i, 0) + idf * tf * (k1 + 1) / damp
    return {i: round(s, 6) for i, s in scores.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id bigint, doc string")


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "the fox fox"), (2, "füchse 42"), (3, "nothing here matches"), (4, "")]
    return as_queries(spark.createDataFrame(rows, "query_id bigint, query string"))


def scores(result, value="score"):
    out = {}
    for r in result.df.collect():
        out.setdefault(r.query_id, {})[r.id] = r[value]
    return out


def test_bm25_is_brute_force(docs, asked):
    found = scores(BM25Searcher(derive_index(docs, {"*": "doc"})).search(asked))
    assert found[1] == pytest.approx(brute_bm25(TEXTS, "the fox fox"), abs=1e-6)
    assert found[2] == pytest.approx(brute_bm25(TEXTS, "füchse 42"), abs=1e-6)
    assert set(found) == {1, 2}


def test_one_index_serves_any_queries(spark, docs, asked):
    """An index computed when it is read isn't tied to the queries it has served."""
    index = derive_index(docs, {"*": "doc"})
    other = as_queries(spark.createDataFrame([(7, "dog"), (8, "lazy quick")], "query_id bigint, query string"))
    first = scores(BM25Searcher(index).search(asked))
    second = scores(BM25Searcher(index).search(other))
    assert first == scores(BM25Searcher(derive_index(docs, {"*": "doc"})).search(asked))
    for query, text in ((7, "dog"), (8, "lazy quick")):
        assert second.get(query, {}) == pytest.approx(brute_bm25(TEXTS, text), abs=1e-6)


def test_both_token_tables_agree(spark, docs, asked):
    """Repeated keys, null vectors and unknown tokens, with the table sent and with it joined."""
    rows = [("fox", [1.0, 0.0]), ("fox", [0.5, 0.5]), ("the", [0.0, 1.0]), ("dog", None), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "key string, vec array<float>")
    hits = BM25Searcher(derive_index(docs, {"*": "doc"})).search(asked)
    sent, joined = (
        scores(MaxSimReranker(docs, table, 2, max_count=10, table_bytes=b).rerank(asked, hits)) for b in (1 << 20, 0)
    )
    assert sent == joined and any(v > 0 for found in sent.values() for v in found.values())


@pytest.mark.parametrize("bound", [10, None])
def test_hits_without_a_number_have_no_rank(spark, bound):
    hits = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (1, 3, 1.0)], "query_id bigint, id bigint, score double")
    fused = ReciprocalRankFusion().fuse([SearchResult(hits, RankMetric.SCORE, bound=bound, n_queries=1)])
    assert {r.id: r.score for r in fused.df.collect()} == {1: pytest.approx(1 / 61), 3: pytest.approx(1 / 62)}


def test_best_window_of_a_long_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x")], "id bigint, doc string")
    asked = as_queries(spark.createDataFrame([(1, "a e f z")], "query_id bigint, query string"))
    hits = SearchResult(spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0)], "query_id bigint, id bigint, score double"), RankMetric.SCORE, bound=2, n_queries=1)
    best = scores(TruncatedPairReranker(docs, max_length=4).rerank(asked, hits))
    first = scores(TruncatedPairReranker(docs, max_length=4, truncate=True).rerank(asked, hits))
    assert best == {1: {1: 0.5, 2: 0.0}} and first == {1: {1: 0.25, 2: 0.0}}


def test_repeated_query_words_count_in_a_bag(docs, asked):
    index = derive_index(docs, {"text": "doc"})
    assert scores(FieldBM25Searcher(index, 10).search(asked))[1] == pytest.approx(
        brute_bm25(TEXTS, "the fox fox", bag=True), abs=1e-6
    )


def test_stored_index_gives_the_same_hits(spark, docs, asked, tmp_path):
    path = str(tmp_path / "index")
    save_index(docs, {"*": "doc"}, path, buckets=4)
    want = scores(BM25Searcher(derive_index(docs, {"*": "doc"})).search(asked))
    assert scores(BM25Searcher(load_index(spark, path)).search(asked)) == want


def test_too_many_query_terms_to_broadcast(spark, docs, asked, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    save_index(docs, {"*": "doc"}, path, buckets=4)
    index = load_index(spark, path)
    want = scores(BM25Searcher(index).search(asked))
    monkeypatch.setattr(searchers.Size, "fits", lambda self: False)
    result = BM25Searcher(index).search(asked)
    assert scores(result) == want
    assert {r.salts for r in index.hot_terms().collect()} == {2, 3} or index.hot_terms().count() > 0


def test_a_delta_without_totals_is_not_read(spark, docs, asked, tmp_path):
    path = str(tmp_path / "index")
    save_index(docs, {"*": "doc"}, path, buckets=4)
    want = scores(BM25Searcher(load_index(spark, path)).search(asked))
    save_index(docs, {"*": "doc"}, path, buckets=4, delta=1)
    shutil.rmtree(tmp_path / "index" / "corpus_stats" / "delta=1")
    assert scores(BM25Searcher(load_index(spark, path)).search(asked)) == want


def test_a_bucket_lies_in_few_files(spark, docs, tmp_path):
    path = tmp_path / "index"
    save_index(docs.repartition(6), {"*": "doc"}, str(path), buckets=4)
    for kind in ("postings", "term_stats"):
        files = [len(list(d.glob("*.parquet"))) for d in (path / kind / "delta=0").glob("bucket=*")]
        assert files and max(files) == 1


def test_append_equals_rebuild(spark, docs, asked, tmp_path):
    path = str(tmp_path / "index")
    save_index(docs.filter("id <= 2"), {"*": "doc"}, path, buckets=4)
    rest = docs.filter("id > 2")
    for _ in range(2):  # a repeated delta replaces itself
        append_index(rest, {"*": "doc"}, path, delta=1, index=load_index(spark, path))
    want = scores(BM25Searcher(derive_index(docs, {"*": "doc"})).search(asked))
    assert scores(BM25Searcher(load_index(spark, path)).search(asked)) == want


def test_english_index_stems_and_drops_stop_words(spark, asked):
    docs = spark.createDataFrame([(1, "the foxes are running"), (2, "the dogs")], "id bigint, doc string")
    index = derive_index(docs, {"*": "doc"}, analyzer="english")
    assert {r.term for r in index.postings.collect()} == {"fox", "run", "dog"}
    query = spark.createDataFrame([(1, "The Fox runs")], "query_id bigint, query string")
    assert set(scores(BM25Searcher(index).search(query))[1]) == {1}


def test_planted_passages_are_found(spark):
    t = Inputs(spark, SF_DIR)
    _, result = keyword_hits(t, 10)
    docs = t.entries().select("id", "content")
    planted = docs.crossJoin(F.broadcast(t.queries())).filter(F.expr("contains(content, query)"))
    truth = {(r.query_id, r.id) for r in planted.select("query_id", "id").collect()}
    assert truth
    assert truth <= {(r.query_id, r.id) for r in result.df.collect()}


def test_one_query_as_text(spark, docs):
    found = create_search_fn(BM25Searcher(derive_index(docs, {"*": "doc"}), 5))("lazy dog")
    assert [r.id for r in found.ranked(5).orderBy("rank").collect()] == [1, 2]


# Vectors


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(300, 8)).astype("float32")
    points[50:150] = points[50]  # a third are copies of one vector
    vectors = spark.createDataFrame(
        [(i, [float(x) for x in p], "m") for i, p in enumerate(points)], "id bigint, vec array<float>, model_name string"
    ).repartition(4)
    queries = spark.createDataFrame(
        [(q, "", [float(x) for x in points[p]]) for q, p in enumerate((3, 50, 299))],
        "query_id bigint, query string, vec array<float>",
    )
    return points.astype("float64"), vectors, as_queries(queries)


def brute_knn(points, query, k, distance=False):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    cosine = unit @ unit[query]
    key = np.round(1 - cosine, 6) if distance else -np.round(cosine, 6)
    best = sorted(range(len(points)), key=lambda i: (key[i], i))[:k]
    return {i: abs(float(key[i])) if distance else -float(key[i]) for i in best}


def test_exact_knn_is_brute_force(cloud):
    points, vectors, queries = cloud
    found = scores(VectorSearcher(vectors, model_name="m", max_count=20).search(queries))
    for q, p in enumerate((3, 50, 299)):
        assert found[q] == pytest.approx(brute_knn(points, p, 20), abs=2e-6)
    assert min(found[1]) == 50 and sorted(found[1]) == list(range(50, 70))


def test_blocked_knn_is_brute_force(cloud, monkeypatch):
    points, vectors, queries = cloud
    monkeypatch.setattr(knn, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 2)
    rows, asked = vectors.withColumn("cell", F.lit(0)), queries.df.withColumn("cells", F.array(F.lit(0)))
    near = knn.blocked_knn(rows, asked, 3, 20, 8, distance=False, digits=6, block_vectors=40, block_queries=2)
    best = top_k(near, 20, [F.col("score").desc(), F.col("id")])
    assert scores(SearchResult(best, RankMetric.SCORE)) == scores(
        VectorSearcher(vectors, model_name="m", max_count=20).search(queries)
    )
    forced = knn.exact_knn(vectors, queries, 20, 8, query_bytes=0)
    assert scores(SearchResult(forced, RankMetric.SCORE)) == scores(SearchResult(best, RankMetric.SCORE))


def test_index_with_all_cells_is_exact(spark, cloud, tmp_path):
    points, vectors, queries = cloud
    build_ivf(vectors, 6).save(str(tmp_path))
    index = load_ivf(spark, str(tmp_path))
    search = VectorSearcher(vectors, model_name="m", max_count=20, use_index=True, index=index, nprobe=6).search(queries)
    assert search.rank_metric is RankMetric.DISTANCE
    found = scores(search, "distance")
    for q, p in enumerate((3, 50, 299)):
        assert found[q] == pytest.approx(brute_knn(points, p, 20, distance=True), abs=2e-6)
    near = index.search(queries, 20, 2)
    blocked = index.search(queries, 20, 2, query_bytes=0)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, blocked.collect()))


def test_index_recall(spark):
    t = Inputs(spark, SF_DIR)
    queries = as_queries(t.hybrid_queries())
    index = build_ivf(t.vectors(), n_cells(t))
    near = vector_searcher(t, use_index=True, index=index, nprobe=16).search(queries).ranked(10)
    exact = vector_searcher(t).search(queries).ranked(10)
    shared = near.join(exact, ["query_id", "id"]).count()
    assert shared / exact.count() >= 0.75


def test_vectors_of_wrong_length_fail(spark, cloud):
    _, vectors, queries = cloud
    odd = spark.createDataFrame([(999, [1.0], "m")], vectors.schema)
    with pytest.raises(Exception, match="not all of length 8"):
        VectorSearcher(vectors.union(odd), model_name="m", max_count=5).search(queries).df.collect()


def test_zero_and_null_vectors_match_nothing(spark, cloud):
    _, vectors, queries = cloud
    odd = spark.createDataFrame([(998, [0.0] * 8, "m"), (999, None, "m")], vectors.schema)
    search = VectorSearcher(vectors.union(odd), model_name="m", max_count=1000).search(queries)
    assert {i for hits in scores(search).values() for i in hits} == set(range(300))
    assert build_ivf(vectors.union(odd), 3).vectors.count() == 300


def test_unknown_model(cloud):
    with pytest.raises(ValueError, match="no vectors"):
        VectorSearcher(cloud[1], model_name="other", max_count=5)


def test_embedding_keeps_nulls(spark):
    texts = spark.createDataFrame([(1, "a b b"), (2, None), (3, "")], "id int, doc string")
    out = {r.id: r.v for r in texts.select("id", embed(F.col("doc"), HashingEmbedder(16)).alias("v")).collect()}
    assert out[2] is None and out[3] == [0.0] * 16
    assert sum(x * x for x in out[1]) == pytest.approx(1)


# Ranks and fusion


@pytest.fixture(scope="module")
def two_lists(spark):
    schema_a, schema_b = "query_id bigint, id bigint, score double", "query_id bigint, id bigint, distance double"
    a = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 2.0)], schema_a)
    b = spark.createDataFrame([(1, 2, 0.1), (1, 4, 0.2)], schema_b)
    return [
        SearchResult(a, RankMetric.SCORE, bound=3, n_queries=1),
        SearchResult(b, RankMetric.DISTANCE, bound=2, n_queries=1),
    ]


def empty(spark):
    queries = spark.createDataFrame([(1, "q")], "query_id bigint, query string")
    return NullSearcher().search(queries)


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize(
    "mode, want",
    [
        ("sum_inverse", {2: 0.032522, 1: 0.016393, 3: 0.016129, 4: 0.016129}),
        ("inverse_sum", {2: 0.008130, 1: 0.016393, 3: 0.016129, 4: 0.016129}),
    ],
)
def test_rrf(spark, two_lists, mode, want, bounded):
    lists = two_lists
    if not bounded:
        lists = [SearchResult(r.df, r.rank_metric, n_queries=1) for r in lists]
    fused = ReciprocalRankFusion(mode=mode).fuse([*lists, empty(spark)])
    assert scores(fused)[1] == pytest.approx(want, abs=1e-6)
    assert scores(ReciprocalRankFusion(mode=mode).fuse(lists[::-1])) == scores(fused)


def test_rrf_honours_k_and_limit(two_lists):
    fused = ReciprocalRankFusion(k=0, max_count=1).fuse(two_lists)
    assert scores(fused) == {1: {2: 1.5}}


def test_chain_keeps_the_first_list(spark, two_lists):
    fused = ChainFusion().fuse([two_lists[0], empty(spark), two_lists[1]])
    assert fused.rank_metric is RankMetric.UNDEFINED
    assert scores(fused)[1] == {1: 3.0, 2: 2.0, 3: 2.0, 4: 0.2}
    assert [r.id for r in fused.ranked(10).orderBy("rank").collect()] == [1, 2, 3, 4]
    again = ChainFusion().fuse([fused, two_lists[1]])
    assert set(scores(again)[1]) == {1, 2, 3, 4}


def test_chain_drops_repeats_in_one_list(spark):
    twice = spark.createDataFrame([(1, 7, 1.0), (1, 7, 2.0)], "query_id bigint, id bigint, score double")
    assert scores(ChainFusion().fuse([SearchResult(twice, RankMetric.SCORE)])) == {1: {7: 2.0}}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(-4000, 4000)), min_size=1, max_size=40), st.booleans())
def test_unbounded_dense_ranks(spark, pairs, descending):
    rows = [(q, i, v / 1500) for i, (q, v) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "query_id bigint, id bigint, score double")
    want = dense_ranks(df, "score", descending).select("query_id", "id", "rank")
    got = dense_ranks_unbounded(df, "score", descending).select("query_id", "id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_top_k_beyond_the_group_limit(spark):
    df = spark.range(5000).select(F.lit(1).alias("query_id"), "id", (F.col("id") % 100).cast("double").alias("score"))
    got = top_k(df, 1500, [F.col("score").desc(), F.col("id")])
    want = sorted(range(5000), key=lambda i: (-(i % 100), i))[:1500]
    assert [r.id for r in got.orderBy("rank").collect()] == want


def test_salted_join_is_a_join(spark):
    big = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    got = salted_join(big, small, ["k"], F.col("id"), salts=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))


# Reranking and retrieval


def test_pair_scores(spark, docs, asked):
    hits = BM25Searcher(derive_index(docs, {"*": "doc"}), 10).search(asked)
    ranked = PairReranker(docs).rerank(asked, hits)
    assert scores(ranked)[1] == {1: 1.0, 2: 0.5, 3: 0.5}
    cut = TruncatedPairReranker(docs, max_length=1, truncate=True).rerank(asked, hits)
    assert scores(cut)[1] == {1: 0.5, 2: 0.5, 3: 0.0}
    assert PairReranker(docs, max_count=1).rerank(asked, hits).df.filter("query_id = 1").count() == 1


def test_model_scorer_runs_in_batches(docs, asked):
    def load():
        return lambda queries, texts: np.array([len(q) + len(d) for q, d in zip(queries, texts)])

    hits = BM25Searcher(derive_index(docs, {"*": "doc"}), 10).search(asked)
    got = scores(PairReranker(docs, batch_scorer(load)).rerank(asked, hits))
    assert got[1][2] == len("the fox fox") + len("the the the dog")


@pytest.mark.parametrize("table_bytes", [1 << 20, 0])
def test_max_sim_is_brute_force(spark, docs, asked, table_bytes):
    rng = np.random.default_rng(1)
    vocabulary = sorted({w for _, text in TEXTS for w in words(text)} - {"lazy"})
    vecs = {w: rng.normal(size=4) for w in vocabulary}
    table = spark.createDataFrame([(w, [float(x) for x in v]) for w, v in vecs.items()], "key string, vec array<double>")
    hits = BM25Searcher(derive_index(docs, {"*": "doc"}), 10).search(asked)
    rerank = MaxSimReranker(docs, table, 4, max_count=10, table_bytes=table_bytes)
    got = scores(rerank.rerank(asked, hits))
    for query_id, query in ((1, "the fox fox"), (2, "füchse 42")):
        for i, text in TEXTS:
            given = [vecs[w] for w in words(text) if w in vecs]
            want = sum(max(float(vecs[w] @ d) for d in given) for w in words(query) if w in vecs) if given else 0.0
            if i in got[query_id]:
                assert got[query_id][i] == pytest.approx(want, abs=1e-5)
    assert set(got) == {1, 2}


@pytest.fixture(scope="module")
def library(spark):
    entries = spark.createDataFrame(
        [(i, i % 3 if i != 4 else None, f"t{i}", "a", None if i == 2 else f"c{i}", "l", [], None) for i in range(1, 9)],
        schema.ENTRIES,
    )
    issues = spark.sql("select id, date'2020-01-01' publish_date, '' url, 0 num_entries from range(2)")
    return entries, issues


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("blocked", [True, False])
def test_retrieve(spark, library, tmp_path, bounded, blocked):
    entries, issues = library
    if blocked:
        write_blocks(entries, str(tmp_path))
        entries = spark.read.parquet(str(tmp_path))
    hits = spark.createDataFrame([(1, i, float(i)) for i in range(1, 12)], "query_id bigint, id bigint, score double")
    result = SearchResult(hits, RankMetric.SCORE, bound=11 if bounded else None, n_queries=1 if bounded else None)
    rows = result.retrieve(entries, issues, 3).orderBy("rank").collect()
    # 8, 5 and 2 are of issue 2, which is unknown; 4 has no issue.
    assert [(r.rank, r.id) for r in rows] == [(1, 7), (2, 6), (3, 3)]
    assert rows[0].date == "2020-01-01" and rows[0].content == "c7"


def test_null_content_is_empty(spark, library):
    entries, issues = library
    issues = issues.union(spark.sql("select 2L, date'2020-01-02', '', 0"))
    hits = spark.createDataFrame([(1, 2, 1.0)], "query_id bigint, id bigint, score double")
    assert SearchResult(hits, RankMetric.SCORE).retrieve(entries, issues, 3).first().content == ""


def test_blocks_are_pruned_at_run_time(spark, library, tmp_path):
    write_blocks(library[0], str(tmp_path), width=2)
    table = spark.read.parquet(str(tmp_path))
    hits = spark.createDataFrame([(1, 7, 1.0)], "query_id bigint, id bigint, score double")
    joined = SearchResult(hits, RankMetric.SCORE, bound=1, n_queries=1).fetch(table)
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in joined.collect()] == [7]


# The search function and the metric


def test_search_function_checks_its_parts(docs):
    searcher = BM25Searcher(derive_index(docs, {"*": "doc"}), 5)
    with pytest.raises(ValueError):
        create_search_fn([])
    with pytest.raises(ValueError):
        create_search_fn(searcher, fusion_method=ChainFusion())
    with pytest.raises(ValueError):
        create_search_fn([searcher, searcher])


def test_metric(spark):
    df = spark.range(0)
    assert SearchResult(df, RankMetric.SCORE).descending() is True
    assert SearchResult(df, RankMetric.DISTANCE).descending() is False
    assert SearchResult(df, RankMetric.UNDEFINED).col() == "undefined_metric"
    with pytest.raises(ValueError):
        SearchResult(df, RankMetric.UNDEFINED).descending()
    with pytest.raises(ValueError):
        SearchResult(df, RankMetric.UNDEFINED).order_by()


def test_stored_index_scan_is_pruned(spark, docs, asked, tmp_path):
    path = str(tmp_path / "index")
    save_index(docs, {"*": "doc"}, path, buckets=8)
    result = BM25Searcher(load_index(spark, path), 5).search(asked)
    plan = result.df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
