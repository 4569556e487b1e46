"""The engine's tables, derived from the given parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

BASE_URL = "https://weekly.example"


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def entries(self) -> DataFrame:
        """Documents as newsletter entries, dealt to all issues."""
        return self._entries(lambda step, value: value, 0)

    def entries_with_gaps(self) -> DataFrame:
        """The same with nulls in every optional column, and some issues that don't exist."""
        doc_id = F.col("doc_id")
        return self._entries(lambda step, value: F.when(doc_id % step != 0, value), 7)

    def _entries(self, unless: Callable[[int, Column], Column], unknown_issues: int) -> DataFrame:
        doc_id = F.col("doc_id")
        n_issues = self.table("pages").agg(F.count("*")).scalar() + unknown_issues
        link = F.concat(
            F.lit("https://"), "source", F.lit(".example.com/doc/"), doc_id, F.lit("?ref="), "lang"
        )
        main_link = unless(7, link)
        return self.table("documents").select(
            doc_id.alias("id"),
            (doc_id % n_issues).cast("int").alias("issue_id"),
            F.substring_index("text", "\n", 1).alias("title"),
            unless(5, F.col("source")).alias("author"),
            unless(11, F.col("text")).alias("content"),
            main_link.alias("main_link"),
            F.array(main_link, F.concat(F.lit("https://x.example/"), doc_id), main_link).alias("other_links"),
            unless(3, F.col("lang")).alias("tag"),
        )

    def issues(self) -> DataFrame:
        return self.table("pages").select(
            F.col("page_id").alias("id"),
            F.date_add(F.lit("2013-05-01").cast("date"), (F.col("page_id") * 7).cast("int")).alias("publish_date"),
            "url",
        )

    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    def hybrid_queries(self) -> DataFrame:
        """Each query text with the vector of the same number, null if there is none."""
        vecs = self.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
        return self.queries().join(vecs, "query_id", "left")

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit("test/model").alias("model_name")
        )

    def labelled_vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"),
            F.col("embedding").alias("vec"),
            F.concat(F.lit("test/model "), "label").alias("model_name"),
        )

    def token_vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))

    def token_key(self):
        """Token to row of the vector table, by hash."""
        n = self.table("embeddings").count()
        return lambda token: F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % n

    def catalog_lines(self) -> DataFrame:
        """One catalog line per order; some in a form that does not parse."""
        key = F.col("o_orderkey").cast("string")
        good = F.concat(F.lit("Issue #"), key, F.lit(" — "), F.date_format("o_orderdate", "MMMM d, yyyy"))
        line = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("Issue "), key, F.lit(": unknown")))
        absolute = F.concat(F.lit("https://other.example/"), key)
        href = F.when(F.col("o_orderstatus") == "O", absolute).otherwise(F.concat(F.lit("/issues/"), key))
        return self.table("orders").select(F.coalesce(line, good).alias("line"), href.alias("href"))

    def newsletter_pages(self) -> DataFrame:
        """One page per document, in one of the three layouts or in none."""

        def safe(col: Column) -> Column:
            for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                col = F.replace(col, F.lit(raw), F.lit(written))
            return col

        key = F.col("doc_id").cast("string")
        title = safe(F.substring_index("text", "\n", 1))
        text, author, tag = safe(F.col("text")), F.col("source"), F.col("lang")

        def page(template: str) -> Column:
            parts = {"{key}": key, "{title}": title, "{text}": text, "{author}": author, "{tag}": tag}
            out, rest = [], template
            while rest:
                at = {rest.find(p): p for p in parts if p in rest}
                if not at:
                    out.append(F.lit(rest))
                    break
                start = min(at)
                out += [F.lit(rest[:start]), parts[at[start]]]
                rest = rest[start + len(at[start]) :]
            return F.concat(*out)

        described = page(
            '<html><body><div id="content"><table class="el-item a"><tr><td><p class="desc">'
            '<span class="mainlink"><a href="https://a.example/{key}?utm=1">{title}</a></span> — {text}'
            '<a href="https://b.example/{key}?utm=2"> more</a></p><p class="name">{author}</p></td></tr></table>'
            '<table class="item"><tr><td><p class="desc"><a href="https://c.example/{key}">{title}</a> '
            '<span class="name">{author}</span></p></td></tr></table></div></body></html>'
        )
        primary = page(
            '<html><body><table class="item"><tr><td><div><a class="primary" href="https://a.example/{key}?utm=1#x">'
            '{title}</a></div><div>{text}<br><a href="https://b.example/{key}?utm=2">ref</a></div></td></tr>'
            '<tr><td class="metadata"> {author} #{tag}</td></tr></table></body></html>'
        )
        titled = page(
            '<table><tr><td><a title="t" href="https://a.example/{key}?utm=1">{title}</a></td></tr>'
            '<tr><td>{text}<a href="https://b.example/{key}?utm=2">src</a></td></tr><tr><td>{author}</td></tr></table>'
        )
        broken = page('<a title="alone" href="https://a.example/{key}">{title}</a>')
        which = F.col("doc_id") % 4
        html = F.when(which == 0, described).when(which == 1, primary).when(which == 2, titled).otherwise(broken)
        return self.table("documents").select(F.col("doc_id").alias("issue_id"), html.alias("html"))
