"""Table schemas, the document view and the data-quality report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISSUES = "id bigint, publish_date date, url string, num_entries int"
ENTRIES = (
    "id bigint, issue_id int, title string, author string, content string, "
    "main_link string, other_links array<string>, tag string"
)
VECTORS = "id bigint, vec array<float>, model_id int"


def documents(entries: DataFrame) -> DataFrame:
    """``(id, doc)``: title, author, content and tag, one per line, null as empty."""
    parts = [F.coalesce(c, F.lit("")) for c in ("author", "content", "tag")]
    keep = [c for c in ("id", "id_block") if c in entries.columns]
    return entries.select(*keep, F.concat_ws("\n", "title", *parts).alias("doc"))


def model_registry(vectors: DataFrame) -> DataFrame:
    """One row per model: name, dimension, index file name, number of vectors."""
    file_name = F.concat(F.regexp_replace("model_name", r"[-\s/]+", "-"), F.lit(".bin"))
    return (
        vectors.groupBy("model_name")
        .agg(F.max(F.size("vec")).alias("dimension"), F.count("*").alias("n_vectors"))
        .withColumn("index_filename", file_name)
    )


def quality_checks(issues: DataFrame, entries: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """``(rule, violations)`` for keys, required columns, references and sizes.

    A key is violated by every row beyond the first that has it; rows without a key aren't
    repeats of each other.
    """

    def repeated(df: DataFrame, key: str, rule: str) -> DataFrame:
        groups = df.filter(F.col(key).isNotNull()).groupBy(key).agg((F.count("*") - 1).alias("n"))
        return groups.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))

    def failing(df: DataFrame, rules: dict[str, F.Column]) -> DataFrame:
        counts = df.agg(*[F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(rules.values())])
        rows = [F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(rules)]
        return counts.select(F.inline(F.array(*rows)))

    # Counted per issue first: one issue may own a third of the entries.
    owners = entries.filter(F.col("issue_id").isNotNull()).groupBy("issue_id").agg(F.count("*").alias("n"))
    orphans = owners.join(issues.select(F.col("id").cast("int").alias("issue_id")), "issue_id", "left_anti")
    parts = [
        repeated(issues, "id", "issues.id unique"),
        repeated(entries, "id", "entries.id unique"),
        repeated(vectors, "id", "vectors.id unique"),
        failing(
            issues,
            {
                "issues.publish_date not null": F.col("publish_date").isNull(),
                "issues.url not null": F.col("url").isNull(),
            },
        ),
        failing(entries, {"entries.title not null": F.col("title").isNull()}),
        failing(
            vectors,
            {
                "vectors.vec not null": F.col("vec").isNull(),
                "vectors.vec length": F.col("vec").isNotNull() & (F.size("vec") != dimension),
            },
        ),
        orphans.agg(
            F.lit("entries.issue_id known").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations")
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
