"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.embed import HashingEmbedder, embed
from ..functions.urls import join_url, markdown_link, remove_first, strip_query
from ..operators.fusion import ChainFusion, ReciprocalRankFusion
from ..operators.ivf import IvfIndex, build_ivf, load_ivf, recall
from ..operators.bounded_bm25 import BoundedBM25, block_maxima
from ..operators.pruned_cells import build_pruned, load_pruned, pruned_search
from ..operators.keyword_index import TEXT_FIELDS, WHOLE, KeywordIndex, derive_index, load_index, save_index
from ..operators.rerank import MaxSimReranker, PairReranker, TruncatedPairReranker
from ..operators.searchers import BM25Searcher, FieldBM25Searcher, VectorSearcher
from ..sources import catalog, pages, store
from ..sources.page_files import read_page_files, write_page_files
from ..sources.registry import register_vectors
from .inputs import BASE_URL, Inputs
from .queryset import QuerySet, as_queries
from .result import SearchResult
from .search_fn import create_search_fn

# The sizes the reference application asks for.
CANDIDATES = 50
FINAL = 20
MODEL = "test/model"
DIMENSION = 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return fn


def document_index(t: Inputs, analyzer: str = "simple") -> KeywordIndex:
    return derive_index(schema.documents(t.entries()), {WHOLE: "doc"}, analyzer=analyzer)


def field_index(t: Inputs) -> KeywordIndex:
    return derive_index(t.entries(), {f: f for f in TEXT_FIELDS})


def keyword_searcher(t: Inputs, max_count: int | None = CANDIDATES) -> BM25Searcher:
    return BM25Searcher(document_index(t), max_count)


def field_searcher(t: Inputs) -> FieldBM25Searcher:
    return FieldBM25Searcher(field_index(t), CANDIDATES)


def vector_searcher(t: Inputs, **options) -> VectorSearcher:
    return VectorSearcher(t.vectors(), model_name=MODEL, max_count=CANDIDATES, **options)


def n_cells(t: Inputs) -> int:
    return max(1, int(t.table("embeddings").count() ** 0.5))


def two_lists(t: Inputs) -> tuple[QuerySet, list[SearchResult]]:
    asked = as_queries(t.hybrid_queries())
    return asked, [keyword_searcher(t).search(asked), vector_searcher(t).search(asked)]


def keyword_hits(t: Inputs, max_count: int = FINAL) -> tuple[QuerySet, SearchResult]:
    asked = as_queries(t.queries())
    return asked, keyword_searcher(t, max_count).search(asked)


# Keyword index


@query
def index_postings(t):
    return document_index(t).postings.select("term", "id", "tf", "dl")


@query
def index_term_stats(t):
    return document_index(t).term_stats.select("term", "df")


@query
def index_corpus_stats(t):
    return document_index(t).corpus_stats.select("n", "total_len")


@query
def index_field_stats(t):
    index = field_index(t)
    terms = index.term_stats.groupBy("field").agg(F.count("*").alias("n_terms"), F.sum("df").alias("sum_df"))
    return index.corpus_stats.select("field", "n", "total_len").join(F.broadcast(terms), "field")


# Base searchers


@query
def bm25_document(t):
    return keyword_hits(t, CANDIDATES)[1].ranked(CANDIDATES)


@query
def bm25_document_all(t):
    asked = as_queries(t.queries())
    return keyword_searcher(t, None).search(asked).df


@query
def bm25_fields(t):
    asked = as_queries(t.queries())
    return field_searcher(t).search(asked).ranked(CANDIDATES)


@query
def bm25_english(t):
    asked = as_queries(t.queries())
    index = document_index(t, "english")
    return BM25Searcher(index, CANDIDATES, idf_base=10).search(asked).ranked(CANDIDATES)


def stored_index(t: Inputs, docs: DataFrame, fields: dict[str, str]) -> KeywordIndex:
    """An index written to the shared folder and read again, as a deployment has it."""
    path = f"{store.shared_dir(t.spark)}/index-{uuid.uuid4().hex}"
    save_index(docs, fields, path, buckets=16)
    return load_index(t.spark, path)


@query
def bm25_stored(t):
    index = stored_index(t, schema.documents(t.entries()), {WHOLE: "doc"})
    return BM25Searcher(index, CANDIDATES).search(t.queries()).ranked(CANDIDATES)


@query
def bm25_fields_stored(t):
    index = stored_index(t, t.entries(), {f: f for f in TEXT_FIELDS})
    return FieldBM25Searcher(index, CANDIDATES).search(t.queries()).ranked(CANDIDATES)


def stored_bounds(t: Inputs) -> tuple[KeywordIndex, DataFrame]:
    """A stored document index and, written beside it, the largest term part per block."""
    path = f"{store.shared_dir(t.spark)}/index-{uuid.uuid4().hex}"
    save_index(schema.documents(t.entries()), {WHOLE: "doc"}, path, buckets=16)
    index = load_index(t.spark, path)
    block_maxima(index).write.parquet(f"{path}/block_maxima")
    return index, t.spark.read.parquet(f"{path}/block_maxima")


@query
def bm25_pruned(t):
    """Top 50 BM25 documents, scoring only blocks whose bound reaches a floor of the 50th score."""
    index, maxima = stored_bounds(t)
    return BoundedBM25(index, maxima, CANDIDATES).search(t.queries()).ranked(CANDIDATES)


def stored_cells(t: Inputs) -> tuple[IvfIndex, int]:
    cells = n_cells(t)
    path = f"{store.shared_dir(t.spark)}/cells-{uuid.uuid4().hex}"
    build_ivf(t.vectors(), cells, max_iter=5).save(path)
    return load_ivf(t.spark, path), cells


@query
def knn_index_stored(t):
    """A stored cell index with every cell probed, where it has to be exact."""
    index, cells = stored_cells(t)
    return vector_searcher(t, use_index=True, index=index, nprobe=cells).search(t.hybrid_queries()).ranked(CANDIDATES)


@query
def hybrid_stored(t):
    """Both stored indexes, chained, pair-scored and retrieved from stored entries."""
    path = f"{store.shared_dir(t.spark)}/entries-{uuid.uuid4().hex}"
    store.write_blocks(t.entries(), path, width=20_000)
    entries = t.spark.read.parquet(path)
    index, cells = stored_cells(t)
    search = create_search_fn(
        [
            FieldBM25Searcher(stored_index(t, entries, {f: f for f in TEXT_FIELDS}), CANDIDATES),
            vector_searcher(t, use_index=True, index=index, nprobe=cells),
        ],
        fusion_method=ChainFusion(),
        reranker=PairReranker(schema.documents(entries)),
    )
    return search(t.hybrid_queries()).retrieve(entries, t.issues(), FINAL)


@query
def knn_exact(t):
    return vector_searcher(t).search(t.hybrid_queries()).ranked(CANDIDATES)


@query
def knn_distance(t):
    """The index path with every cell probed, where it has to be exact."""
    cells = n_cells(t)
    index = build_ivf(t.vectors(), cells, max_iter=5)
    return vector_searcher(t, use_index=True, index=index, nprobe=cells).search(t.hybrid_queries()).ranked(CANDIDATES)


def stored_pruned(t: Inputs):
    path = f"{store.shared_dir(t.spark)}/pruned-{uuid.uuid4().hex}"
    build_pruned(t.vectors(), n_cells(t)).save(path)
    return load_pruned(t.spark, path)


@query
def knn_pruned(t):
    """Exact top 50 by cosine distance, reading only cells whose angular bound can reach the 50th."""
    return pruned_search(stored_pruned(t), t.hybrid_queries(), CANDIDATES)[0]


@query
def knn_by_name(t):
    """Vectors of several models written with a registry; the searcher finds its model by name."""
    root = f"{store.shared_dir(t.spark)}/models-{uuid.uuid4().hex}"
    register_vectors(t.vectors().unionByName(t.labelled_vectors()), root)
    return VectorSearcher.by_name(t.spark, root, MODEL, max_count=CANDIDATES).search(t.hybrid_queries()).ranked(CANDIDATES)


@query
def knn_text(t):
    """Documents and query texts through the embedding function."""
    embedder = HashingEmbedder(DIMENSION)
    docs = schema.documents(t.entries())
    vectors = docs.select("id", embed(F.col("doc"), embedder).alias("vec"), F.lit("hashing").alias("model_name"))
    searcher = VectorSearcher(vectors, model_name="hashing", max_count=FINAL, embedder=embedder)
    return searcher.search(t.queries()).ranked(FINAL)


@query
def ann_recall(t):
    asked = as_queries(t.hybrid_queries())
    index = build_ivf(t.vectors(), n_cells(t))
    near = vector_searcher(t, use_index=True, index=index, nprobe=8).search(asked).ranked(10)
    return recall(near, vector_searcher(t).search(asked).ranked(10))


# Fusion


@query
def fuse_chain(t):
    fused = ChainFusion().fuse(two_lists(t)[1])
    return fused.ranked(2 * CANDIDATES).select("query_id", "id", "score", "rank")


@query
def fuse_rrf(t):
    return ReciprocalRankFusion(max_count=CANDIDATES).fuse(two_lists(t)[1]).ranked(CANDIDATES)


@query
def fuse_rrf_inverse_sum(t):
    fused = ReciprocalRankFusion(max_count=CANDIDATES, mode="inverse_sum").fuse(two_lists(t)[1])
    return fused.ranked(CANDIDATES)


@query
def fuse_rrf_all(t):
    """A keyword list without a limit, ranked in slices."""
    asked = as_queries(t.hybrid_queries())
    lists = [keyword_searcher(t, None).search(asked), vector_searcher(t).search(asked)]
    return ReciprocalRankFusion().fuse(lists).df


# Reranking


@query
def rerank_fetch(t):
    asked, hits = keyword_hits(t)
    return PairReranker(schema.documents(t.entries())).retrieve_docs(hits)


@query
def rerank_pair(t):
    asked, hits = keyword_hits(t)
    return PairReranker(schema.documents(t.entries())).rerank(asked, hits).ranked(FINAL)


@query
def rerank_pair_truncated(t):
    asked, hits = keyword_hits(t)
    return TruncatedPairReranker(schema.documents(t.entries()), max_length=128).rerank(asked, hits).ranked(FINAL)


def max_sim(t: Inputs) -> MaxSimReranker:
    return MaxSimReranker(
        schema.documents(t.entries()), t.token_vectors(), DIMENSION, max_count=FINAL, token_key=t.token_key()
    )


@query
def rerank_maxsim(t):
    asked, hits = keyword_hits(t)
    return max_sim(t).rerank(asked, hits).ranked(FINAL)


# Retrieval and whole searches


@query
def retrieve(t):
    return keyword_hits(t, CANDIDATES)[1].retrieve(t.entries(), t.issues(), FINAL)


def hybrid_search(t: Inputs) -> DataFrame:
    asked = as_queries(t.hybrid_queries())
    search = create_search_fn(
        [keyword_searcher(t), vector_searcher(t)],
        fusion_method=ReciprocalRankFusion(),
        reranker=PairReranker(schema.documents(t.entries())),
    )
    return search(asked).retrieve(t.entries(), t.issues(), FINAL)


@query
def hybrid_end_to_end(t):
    return hybrid_search(t)


@query
def hybrid_chain_fields(t):
    """Field search and index search, chained, pair-scored, retrieved."""
    asked = as_queries(t.hybrid_queries())
    cells = n_cells(t)
    index = build_ivf(t.vectors(), cells, max_iter=5)
    search = create_search_fn(
        [field_searcher(t), vector_searcher(t, use_index=True, index=index, nprobe=cells)],
        fusion_method=ChainFusion(),
        reranker=PairReranker(schema.documents(t.entries())),
    )
    return search(asked).retrieve(t.entries(), t.issues(), FINAL)


@query
def hybrid_chain_maxsim(t):
    """Keyword and vector search, chained, reranked by late interaction, retrieved."""
    asked = as_queries(t.hybrid_queries())
    search = create_search_fn(
        [keyword_searcher(t), vector_searcher(t)], fusion_method=ChainFusion(), reranker=max_sim(t)
    )
    return search(asked).retrieve(t.entries(), t.issues(), FINAL)


@query
def result_links(t):
    rows = hybrid_search(t)
    return rows.select(
        "query_id", "rank", "id", markdown_link(F.col("title"), F.col("main_link")).alias("title"), "author", "date"
    )


# Ingestion


@query
def documents_view(t):
    return schema.documents(t.entries_with_gaps())


@query
def catalog_parse(t):
    return catalog.parse_catalog(t.catalog_lines(), BASE_URL)[0]


@query
def catalog_page(t):
    """Catalog pages of up to 1,000 issues each, made from the orders, read back to issues."""
    lines = t.catalog_lines()
    head = F.regexp_extract("line", r"^(Issue #\d+)( — .*)$", 1)
    rest = F.regexp_extract("line", r"^(Issue #\d+)( — .*)$", 2)
    link = F.concat(F.lit('<a class="t" href="'), F.col("href"), F.lit('">'))
    inner = F.when(head != "", F.concat(link, head, F.lit("</a><time>"), rest, F.lit("</time>"))).otherwise(
        F.concat(link, F.col("line"), F.lit("</a>"))
    )
    item = F.concat(F.lit('\n  <div class="issue">'), inner, F.lit("</div>"))
    numbered = lines.withColumn("page", F.floor(F.regexp_extract("line", r"(\d+)", 1).cast("long") / 1000))
    html = numbered.groupBy("page").agg(
        F.concat(F.lit('<html><div class="head"><a href="/">home</a></div><div class="issues">'),
                 F.array_join(F.collect_list(item), ""), F.lit("</div></html>")).alias("html")
    )
    return catalog.parse_catalog(catalog.catalog_lines(html), BASE_URL)[0]


@query
def catalog_quarantine(t):
    return catalog.parse_catalog(t.catalog_lines(), BASE_URL)[1]


@query
def tag_extract(t):
    text = F.concat(F.coalesce("author", F.lit("nobody")), F.coalesce(F.concat(F.lit(" #"), "tag"), F.lit("")))
    rows = t.entries_with_gaps().select("id", F.trim(text).alias("text"))
    return rows.select(
        "id", pages.metadata_tag(F.col("text")).alias("tag"), pages.metadata_author(F.col("text")).alias("author")
    )


@query
def url_strip_query(t):
    return t.table("pages").select("page_id", strip_query(F.col("url")).alias("url"))


@query
def url_join(t):
    """Every link of a page and the page's own address, against one base."""
    links = F.array_append(pages.page_links(F.col("html")), F.col("url"))
    hrefs = t.table("pages").select("page_id", F.posexplode(links).alias("pos", "href"))
    return hrefs.select("page_id", "pos", join_url(BASE_URL, F.col("href")).alias("url"))


@query
def page_titles(t):
    return t.table("pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@query
def page_links(t):
    return t.table("pages").select("page_id", F.posexplode(pages.page_links(F.col("html"))).alias("pos", "link"))


@query
def pages_from_files(t):
    """The pages written out as one file each, read back from the folder, and their links."""
    folder = f"{store.shared_dir(t.spark)}/page-files-{uuid.uuid4().hex}"
    write_page_files(t.table("pages"), folder)
    read, _ = read_page_files(t.spark, folder)
    return read.select("page_id", F.posexplode(pages.page_links(F.col("html"))).alias("pos", "link"))


@query
def links_minus_main(t):
    rest = remove_first(F.col("other_links"), F.col("main_link"))
    return t.entries_with_gaps().select("id", F.posexplode_outer(rest).alias("pos", "link"))


@query
def entries_extract(t):
    rows = pages.entries_of(pages.parse_pages(t.newsletter_pages()))
    return rows.withColumn("other_links", F.array_join("other_links", " "))


@query
def pages_quarantine(t):
    return pages.failures_of(pages.parse_pages(t.newsletter_pages())).select("issue_id")


def known_entries(t: Inputs) -> DataFrame:
    return t.table("labels").select(F.col("doc_id").alias("id"))


@query
def ingest_new(t):
    return store.new_keys(t.entries(), known_entries(t)).select("id", "issue_id", "title")


@query
def ingest_upsert(t):
    incoming = catalog.parse_catalog(t.catalog_lines(), BASE_URL)[0]
    return store.insert_or_ignore(incoming, t.issues())


@query
def ingest_union(t):
    target = t.entries().join(known_entries(t), "id", "left_semi")
    batch = store.new_keys(t.entries(), known_entries(t)).select("title", "id", "issue_id", "content", "author")
    return store.append_by_name(batch, target).drop("other_links")


@query
def entry_orphans(t):
    """Entries of issues that don't exist."""
    return store.new_keys(t.entries_with_gaps(), t.issues().select(F.col("id").alias("issue_id")), "issue_id").select("id", "issue_id")


@query
def issue_counts(t):
    return pages.entry_counts(t.issues(), t.entries())


@query
def model_registry(t):
    return schema.model_registry(t.labelled_vectors())


@query
def quality_checks(t):
    """The report on tables with repeats, nulls, wrong lengths and entries of unknown issues."""
    issues = t.issues().withColumn("url", F.when(F.col("id") % 9 != 0, F.col("url")))
    entries = t.entries_with_gaps().withColumn("title", F.when(F.col("id") % 6 != 0, F.col("title")))
    short = F.when(F.col("id") % 5 == 0, F.slice("vec", 1, DIMENSION - 1)).when(F.col("id") % 8 != 0, F.col("vec"))
    vectors = t.vectors().withColumn("vec", short)
    twice = [df.unionByName(df.where(F.col("id") % n == 0)) for df, n in ((issues, 10), (entries, 4), (vectors, 3))]
    nameless = twice[1].withColumn("id", F.when(F.col("id") % 7 != 0, F.col("id")))
    return schema.quality_checks(twice[0], nameless, twice[2], DIMENSION)


@query
def embed_docs(t):
    vec = embed(F.col("doc"), HashingEmbedder(DIMENSION))
    rows = schema.documents(t.entries()).select("id", F.posexplode(vec).alias("slot", "value"))
    return rows.select("id", "slot", F.round(F.col("value").cast("double"), 6).alias("value"))
