"""Time index builds and searches; prints one JSON line.

The builds write to the shared folder; searches then load what was written, as
a deployment would.  Every figure covers all queries of the ``benchmark`` table
over all documents.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave import (
    BM25Searcher,
    ChainFusion,
    FieldBM25Searcher,
    HashingEmbedder,
    MaxSimReranker,
    PairReranker,
    ReciprocalRankFusion,
    VectorSearcher,
    as_queries,
    build_ivf,
    create_search_fn,
    embed,
    load_index,
    load_ivf,
    save_index,
)
from rankweave import schema
from rankweave.operators.bounded_bm25 import BoundedBM25, block_maxima
from rankweave.operators.keyword_index import TEXT_FIELDS, WHOLE
from rankweave.operators.pruned_cells import build_pruned, load_pruned, pruned_search
from rankweave.plans.inputs import Inputs
from rankweave.plans.queries import DIMENSION, MODEL
from rankweave.session import local_session
from rankweave.sources import pages
from rankweave.sources.store import shared_dir, write_blocks

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS)
    t = Inputs(spark, SF_DIR)
    root = f"{shared_dir(spark)}/bench-{int(time.time())}"
    times: dict[str, float] = {}

    def timed(name: str, work: Callable[[], object], runs: int = 3) -> None:
        """The median of the runs; builds, which write, are run once."""
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            work()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 3)

    run(t.table("documents"))
    entries_path, issues = f"{root}/entries", t.issues()
    timed("build_entries", lambda: write_blocks(t.entries(), entries_path, width=20_000), 1)
    entries = spark.read.parquet(entries_path)
    documents = schema.documents(entries)
    timed("build_keyword_index", lambda: save_index(documents, {WHOLE: "doc"}, f"{root}/doc", buckets=16), 1)
    timed("build_field_index", lambda: save_index(entries, {f: f for f in TEXT_FIELDS}, f"{root}/field", buckets=16), 1)
    cells = max(1, int(t.table("embeddings").count() ** 0.5))
    timed("build_vector_index", lambda: build_ivf(t.vectors(), cells).save(f"{root}/ivf"), 1)
    timed("embed_documents", lambda: run(documents.select("id", embed(F.col("doc"), HashingEmbedder(DIMENSION)))))
    timed("parse_pages", lambda: run(pages.parse_pages(t.newsletter_pages().repartition("issue_id"))))

    asked = t.hybrid_queries()
    keyword = BM25Searcher(load_index(spark, f"{root}/doc"), 50)
    fields = FieldBM25Searcher(load_index(spark, f"{root}/field"), 50)
    exact = VectorSearcher(t.vectors(), model_name=MODEL, max_count=50)
    ivf = load_ivf(spark, f"{root}/ivf")
    near = VectorSearcher(t.vectors(), model_name=MODEL, max_count=50, use_index=True, index=ivf)
    pair = PairReranker(documents)
    late = MaxSimReranker(documents, t.token_vectors(), DIMENSION, max_count=20, token_key=t.token_key())
    rrf = ReciprocalRankFusion(max_count=50)

    def search(*searchers, **options) -> Callable[[], None]:
        return lambda: run(create_search_fn(list(searchers), **options)(as_queries(asked)).df)

    def rows(*searchers, **options) -> Callable[[], None]:
        find = create_search_fn(list(searchers), **options)
        return lambda: run(find(as_queries(asked)).retrieve(entries, issues, 20))

    timed("bm25_document", search(keyword))
    timed("bm25_fields", search(fields))
    doc_index = load_index(spark, f"{root}/doc")
    timed("build_block_maxima", lambda: block_maxima(doc_index).write.parquet(f"{root}/doc/block_maxima"), 1)
    bounded = BoundedBM25(doc_index, spark.read.parquet(f"{root}/doc/block_maxima"), 50)
    timed("bm25_pruned", lambda: run(bounded.search(as_queries(asked)).df))
    timed("build_pruned_cells", lambda: build_pruned(t.vectors(), cells).save(f"{root}/pruned"), 1)
    pruned = load_pruned(spark, f"{root}/pruned")
    timed("knn_pruned", lambda: run(pruned_search(pruned, asked, 50)[0]))
    timed("knn_exact", search(exact))
    timed("knn_index", search(near))
    timed("fuse_chain", search(keyword, exact, fusion_method=ChainFusion()))
    timed("fuse_rrf", search(keyword, exact, fusion_method=rrf))
    timed("rerank_pair", search(keyword, reranker=pair))
    timed("rerank_maxsim", search(keyword, reranker=late))
    timed("retrieve", rows(keyword))
    timed("hybrid_rrf_pair", rows(keyword, exact, fusion_method=rrf, reranker=pair))
    timed("hybrid_chain_pair", rows(fields, near, fusion_method=ChainFusion(), reranker=pair))
    timed("hybrid_chain_maxsim", rows(keyword, near, fusion_method=ChainFusion(), reranker=late))

    result = {
        "metric": "total_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "n_queries": as_queries(asked).count,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
