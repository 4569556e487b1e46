"""Incremental ingestion: new pages to entries, issues and the keyword index.

Every batch writes directories of its own number, so running a batch again
replaces what it wrote and nothing else.  Its issues are written last: an issue
counts as done once they are there, and a page that failed is tried again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.keyword_index import WHOLE, KeywordIndex, load_index, save_index
from . import catalog, pages
from .store import new_keys, one_per_key, read_if_exists, with_width, write_blocks

ISSUES_STORED = f"{schema.ISSUES}, batch bigint"
ENTRIES_STORED = f"{schema.ENTRIES}, batch bigint, id_block bigint"
INDEX_BUCKETS = 64
# Entry ids are sparse: a block holds so many issues.
ISSUES_PER_BLOCK = 50_000
WIDTH = pages.IDS_PER_ISSUE * ISSUES_PER_BLOCK


class Library:
    """The tables under one folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = INDEX_BUCKETS, analyzer: str = "simple"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.analyzer = analyzer

    def issues(self) -> DataFrame:
        return read_if_exists(self.spark, f"{self.root}/issues", ISSUES_STORED).drop("batch")

    def entries(self) -> DataFrame:
        stored = read_if_exists(self.spark, f"{self.root}/entries", ENTRIES_STORED).drop("batch")
        return with_width(stored, WIDTH)

    def documents(self) -> DataFrame:
        return schema.documents(self.entries())

    def quarantine(self) -> DataFrame:
        """``(batch, issue_id, line, error)`` for pages and lines that could not be read."""
        kinds = "issue_id bigint, line string, error string, batch bigint"
        return read_if_exists(self.spark, f"{self.root}/quarantine", kinds)

    def index(self) -> KeywordIndex:
        return load_index(self.spark, f"{self.root}/index")

    def ingest(self, arrivals: DataFrame, batch: int, base_url: str) -> None:
        """Add the new issues among ``(line, href, html)``."""
        listed, unread = catalog.parse_catalog(arrivals, base_url)
        stored = read_if_exists(self.spark, f"{self.root}/issues", ISSUES_STORED)
        done = stored.filter(F.col("batch") != batch)
        fresh = one_per_key(new_keys(listed, done)).withColumnRenamed("id", "issue_id")
        # Pages are parsed once; all tables of the batch are read from this one.
        parsed_path = f"{self.root}/parsed/batch={batch}"
        pages.parse_pages(fresh).write.mode("overwrite").parquet(parsed_path)
        parsed = self.spark.read.parquet(parsed_path)

        entries = pages.entries_of(parsed)
        write_blocks(entries, f"{self.root}/entries/batch={batch}", width=WIDTH)
        save_index(
            schema.documents(entries),
            {WHOLE: "doc"},
            f"{self.root}/index",
            analyzer=self.analyzer,
            buckets=self.buckets,
            delta=batch,
        )
        nothing = F.lit(None)
        failed = pages.failures_of(parsed).select("issue_id", nothing.cast("string").alias("line"), "error")
        bad = unread.select(nothing.cast("bigint").alias("issue_id"), "line", F.lit("no catalog line").alias("error"))
        failed.unionByName(bad).write.mode("overwrite").parquet(f"{self.root}/quarantine/batch={batch}")
        issues = parsed.filter(F.col("entries").isNotNull()).select(
            F.col("issue_id").alias("id"), "publish_date", "url", F.size("entries").alias("num_entries")
        )
        issues.write.mode("overwrite").parquet(f"{self.root}/issues/batch={batch}")
