"""What the operators share: the input table, scratch tables and row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.store import shared_dir

# Stands for a null id inside joins and groups: every such row is one document.
NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: computed once, and nothing above it is needed again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key_of(id_column: str) -> Column:
    return F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# Text handled at once by a task; arrays made of it take a multiple.
PORTION_BYTES = 4 << 20


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text; a longer text is a batch of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            limit = (int(sizes[at - 1]) if at else 0) + most
            end = max(at + 1, int(np.searchsorted(sizes, limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def per_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """A function for mapInArrow that treats every portion of the column ``text`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield work(batch)

    return run


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with a column added at the end or put in the place of one."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    if name in names:
        arrays[names.index(name)] = values
    else:
        names.append(name)
        arrays.append(values)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def empty_if_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
