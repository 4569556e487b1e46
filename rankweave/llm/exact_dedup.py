"""Exact dedup as a stream with keyed state on disk.

Documents stream in from files; per digest of the normalised text a RocksDB state store
keeps, without expiry, the identifier of the document that stays, where its content lies
and how many equal texts have come.  The state is an aggregate, so rows are merged where
they are read and a text that a third of all rows share reaches its key once per task.
When the stream has run dry, hits are checked against each other byte by byte, and every
document is joined to its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import portions, scratch, texts_of
from .kernels import SPACES

# Files in a micro-batch.
FILES_PER_BATCH = 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEEN = "doc_id long, file string, at long, points long, digest binary"
# Digests of hits are remembered by so many leading bits, so this set can't outgrow 2 MB.
HIT_BITS = 24


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        texts = texts_of(batch, "text")
        points = [len(t) if t.isascii() else len(t.decode()) for t in texts]
        digests = [sha256(normalised(t)).digest() for t in texts]
        arrays = [*(batch.column(c) for c in ("doc_id", "file", "at")), pa.array(points, pa.int64()), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "file", "at", "points", "digest"])


def _located(rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Id, content locator (file and row) and text of documents read from Parquet files."""
    return rows.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at"),
        F.col(text).alias("text"),
    )


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def run_stream(spark: SparkSession, source: str, state: str, checkpoint: str, text: str, doc_id: str, files_per_batch: int) -> None:
    """Take in the files of ``source`` that this checkpoint hasn't seen, then stop.

    Each micro-batch writes the states it changed to its own folder, so one that is run
    again after a failure replaces what it wrote before.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, since a stream takes the path of a single file for a folder's.
    stream = stream.parquet(f"{source[:-1]}[{source[-1]}]")
    seen = _located(stream, text, doc_id).mapInArrow(_digests, _SEEN)
    states = seen.groupBy("digest").agg(
        F.min(F.struct((-F.col("points")).alias("order"), "doc_id", "file", "at")).alias("keep"), F.count("*").alias("n")
    )

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/batch={batch}")

    # Without fallocate, which reserves some MB of disk for every partition of the state.
    with (
        _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB),
        _setting(spark, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false"),
    ):
        query = (
            states.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()


def current(spark: SparkSession, state: str) -> DataFrame:
    """The last state of every digest."""
    schema = (
        "digest binary, keep struct<order: long, doc_id: long, file: string, at: long>, n long, batch long"
    )
    changes = spark.read.schema(schema).parquet(state)
    return changes.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s")).select("digest", "s.*")


def _hit_bits(states: DataFrame) -> np.ndarray:
    """A bitmap over the leading bits of digests that came more than once."""
    # Spark's bitmaps count bits from 1.
    bit = F.conv(F.hex(F.substring("digest", 1, HIT_BITS // 8)), 16, 10).cast("long") + 1
    rows = (
        states.where("n > 1").select(bit.alias("bit"))
        .groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect()
    )
    out = np.zeros(1 << HIT_BITS - 3, np.uint8)
    for r in rows:
        part = np.frombuffer(r.bits, np.uint8)
        start = (r.bucket - 1) * len(part)
        out[start : start + len(part)] |= part
    return out


def _hits(bits: np.ndarray):
    """Normalised bytes of texts that may be hits; equal ones of a task's batch only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found: dict[bytes, bytes] = {}
            for text in texts_of(batch, "text"):
                bare = normalised(text)
                digest = sha256(bare).digest()
                bit = int.from_bytes(digest[: HIT_BITS // 8], "big")
                if bits[bit >> 3] >> (bit & 7) & 1 and found.setdefault(digest, bare) != bare:
                    raise ValueError(f"two texts have the digest {digest.hex()}")
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], names=["digest", "bare"])

    return run


def check_bytes(located: DataFrame, states: DataFrame) -> None:
    """Compare the full normalised bytes of all texts whose digest came again; raise if any differ."""
    hits = located.select("text").mapInArrow(_hits(_hit_bits(states)), "digest binary, bare binary")
    compared = hits.groupBy("digest").agg(F.min("bare").alias("low"), F.max("bare").alias("high"))
    differing = compared.where(F.col("low") != F.col("high")).select(F.hex("digest").alias("digest")).first()
    if differing:
        raise ValueError(f"two texts have the digest {differing.digest}")


def dedup_files(
    spark: SparkSession, source: str, text: str = "text", doc_id: str = "doc_id", files_per_batch: int = FILES_PER_BATCH, home: str | None = None
) -> DataFrame:
    """One row per document in the Parquet files of ``source``, dropped ones too.

    Columns: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.  Texts are
    equal if identical without ASCII white space, null being empty; the one with the most code
    points stays, then the smallest id (null first), then the first in file order, so exactly
    one row of a group is kept even if ids repeat.  A folder given as ``home`` keeps state
    between calls, and a later call takes in only new files.  Other columns are not read, and
    a source without rows gives none.
    """
    ship_package(spark)
    home = home or scratch(spark, "exact-dedup")
    run_stream(spark, source, f"{home}/state", f"{home}/checkpoint", text, doc_id, files_per_batch)
    located = _located(spark.read.parquet(source), text, doc_id)
    states = current(spark, f"{home}/state")
    check_bytes(located, states)
    seen = located.mapInArrow(_digests, _SEEN).select("doc_id", "file", "at", "digest")
    return seen.join(states, "digest").select(
        F.col("doc_id"),
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keep.file")) & (F.col("at") == F.col("keep.at"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_files(spark, f"{sf_dir}/documents.parquet")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
