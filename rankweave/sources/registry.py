"""A stored registry of vector models, written by the build and read by the searcher.

The build writes every model's vectors to a folder of its own and one registry row per model:
name, dimension, number of vectors, where its vectors lie and, if any, where its index lies.
A searcher asks the registry for a name and reads that row alone; it needn't scan vectors to
learn the dimension, and a name nobody built is an error at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schema

REGISTRY = "model_name string, dimension int, n_vectors bigint, index_filename string, vectors_path string, index_path string"


def register_vectors(vectors: DataFrame, root: str, index_paths: dict[str, str] | None = None) -> DataFrame:
    """Write ``vectors(id, vec, model_name)`` by model under ``root`` and the registry beside them.

    Returns the registry as written.  Writing again to the same root replaces both.
    """
    key = F.regexp_replace("model_name", r"[^0-9A-Za-z._-]+", "-")
    vectors.withColumn("model", key).repartition("model").write.mode("overwrite").partitionBy("model").parquet(f"{root}/vectors")
    rows = schema.model_registry(vectors).withColumn("vectors_path", F.concat(F.lit(f"{root}/vectors/model="), key))
    paths = F.create_map(*[F.lit(x) for pair in (index_paths or {}).items() for x in pair]) if index_paths else None
    rows = rows.withColumn("index_path", paths[F.col("model_name")] if paths is not None else F.lit(None).cast("string"))
    rows.select(*[c.split()[0] for c in REGISTRY.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{root}/registry")
    return read_registry(vectors.sparkSession, root)


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(REGISTRY).parquet(f"{root}/registry")


def lookup(spark: SparkSession, root: str, name: str) -> Row:
    """The registry row of ``name``; KeyError if no model of that name was built."""
    found = read_registry(spark, root).where(F.col("model_name") == name).limit(2).collect()  # one row per name
    if not found:
        raise KeyError(f"no model {name!r} in the registry at {root}")
    return found[0]


def model_vectors(spark: SparkSession, row: Row) -> DataFrame:
    """The vectors of a registered model as ``(id, vec, model_name)``."""
    return spark.read.parquet(row.vectors_path).select("id", "vec", F.lit(row.model_name).alias("model_name"))
