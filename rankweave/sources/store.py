"""Writing and reading tables so that later joins read few files."""

from __future__ import annotations

import re
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids per partition directory of a block-stored table, if ids are dense.
BLOCK_WIDTH = 1_000_000
# Writing tasks a full block may be split over.
SLICES = 20


def block_of(width: int = BLOCK_WIDTH) -> Column:
    """The block of the column ``id``."""
    return F.expr(f"id div {width}L")


def block_width(table: DataFrame) -> int | None:
    """How wide the blocks of a stored table are; None if it has none."""
    if "id_block" not in table.columns:
        return None
    return table.schema["id"].metadata.get("block_width")


def with_width(table: DataFrame, width: int) -> DataFrame:
    """Note the width on the ``id`` column; parquet files keep the note."""
    return table.withColumn("id", F.col("id").alias("id", metadata={"block_width": width}))


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as ``spark.checkpoint.dir`` names it.

    Without the setting a local session, whose tasks all run on this machine, gets a
    temporary folder; on a cluster there is no such folder to fall back on.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="rankweave-")
    return _own_dirs[context.applicationId]


def write_blocks(df: DataFrame, path: str, mode: str = "overwrite", width: int = BLOCK_WIDTH) -> None:
    """Store a table keyed by ``id`` in blocks of consecutive ids, sorted by id.

    A task gets whole slices of a block, so files cover narrow ranges of ids
    without the sampling pass of a range partitioning.
    """
    blocked = with_width(df, width).withColumn("id_block", block_of(width))
    (
        blocked.repartition("id_block", F.expr(f"id div {max(1, width // SLICES)}L"))
        .sortWithinPartitions("id_block", "id")
        .write.mode(mode)
        .partitionBy("id_block")
        .parquet(path)
    )


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_by_name(df: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of both, columns matched by name; columns the batch lacks are null."""
    unknown = set(df.columns) - set(target.columns)
    if unknown:
        raise ValueError(f"columns not in the target: {sorted(unknown)}")
    kinds = {f.name: f.dataType for f in target.schema.fields}
    batch = df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns])
    return target.unionByName(batch, allowMissingColumns=True).select(*target.columns)


def new_keys(incoming: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows whose key the table does not hold yet."""
    return incoming.join(existing.select(key), key, "left_anti")


def one_per_key(df: DataFrame, key: str = "id") -> DataFrame:
    """One row of every key, the same whatever order the rows come in."""
    rest = [c for c in df.columns if c != key]
    row = F.struct(F.xxhash64(*rest).alias("_hash"), *rest)
    return df.groupBy(key).agg(F.min(row).alias("_row")).select(key, *[f"_row.{c}" for c in rest])


def insert_or_ignore(incoming: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """The table after adding rows with new keys; of a repeated new key one row stays."""
    return append_by_name(one_per_key(new_keys(incoming, existing, key), key), existing)


def write_vectors(df: DataFrame, path: str) -> None:
    """Store ``(model_id, id, vec)``, replacing only the models in ``df``."""
    (
        df.repartitionByRange("model_id", "id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_id")
        .parquet(path)
    )
