"""Token ids in training order: fixed-stride shards of sequences, written as plain files.

Texts become token ids where they are read and fill sequences of one length; a keyed Feistel
permutation, walked until it lands inside the range, gives every sequence a slot of its own
among all of them, without a shuffle table.  A shard holds a fixed number of slots in order,
so slot s is at byte (s mod per_shard) * stride of file s div per_shard, and reading can start
or go on anywhere.  Sequences are shuffled once, straight to the task that writes their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, empty_if_null, portions, scratch
from .kernels import U64, mix
from .tokens import PART_BYTES, ByteEncoder

LENGTH = 2048
# Sequences in a shard: 16 MB of 16-bit ids.
PER_SHARD = 4096
ROUNDS = 6


def permute(values: np.ndarray, size: int, key: int, backward: bool = False) -> np.ndarray:
    """A keyed permutation of range(size); ``backward`` is its inverse.

    A balanced Feistel network over the smallest even number of bits that holds ``size``;
    values that leave the range go through it again until they are inside.
    """
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) ^ mix(np.array([key], np.int64).view(U64)))
    out = np.array(values, dtype=U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U64(half), out[todo] & mask
        for k in keys[::-1] if backward else keys:
            if backward:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = left << U64(half) | right
        todo = todo[out[todo] >= U64(size)]
    return out.astype(np.int64)


def _tokens(batches: Iterator[pa.RecordBatch], encoder: ByteEncoder, end: int, sizes_only: bool):
    for batch in portions(batches, most=3 * PART_BYTES):
        yield batch.column("doc_id").to_pylist(), encoder.many(batch.column("text"), end, sizes_only)


def _count(tokenizer: tuple[str, str], end: int, length: int):
    """Sequences that each task will fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(n) for _, n in _tokens(batches, ByteEncoder.of(*tokenizer), end, True))
        arrays = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([-(-total // length)], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["task", "n"])

    return run


def _sequences(tokenizer: tuple[str, str], end: int, length: int, first: dict[int, int], counts: dict[int, int], size: int, key: int, per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at = first.get(task, 0)
        began = at
        rest, docs = np.zeros(0, np.uint16), []  # ids that wait, and (document, its place among them, ids before)

        def rows(ids: np.ndarray, n: int) -> pa.RecordBatch:
            nonlocal at, docs
            heads = np.array([p for _, p, _ in docs], np.int64)
            which = np.searchsorted(heads, np.arange(n) * length, "right") - 1
            numbers = np.arange(at, at + n)
            slots = permute(numbers, size, key)
            blob = ids[: n * length].tobytes()
            step = 2 * length
            arrays = [
                pa.array((slots // per_shard).astype(np.int32)),
                pa.array(slots),
                pa.array(numbers),
                pa.array([docs[i][0] for i in which], pa.int64()),
                pa.array([docs[i][2] + j * length - docs[i][1] for j, i in enumerate(which.tolist())], pa.int64()),
                pa.array([blob[i * step : (i + 1) * step] for i in range(n)], pa.binary()),
            ]
            at += n
            keep = int(which[-1]) if n else 0
            docs = [(d, p - n * length, b) for d, p, b in docs[keep:]]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "slot", "sequence_id", "doc_id", "start", "ids"])

        for names, found in _tokens(batches, ByteEncoder.of(*tokenizer), end, False):
            parts, place = [rest], len(rest)
            for name, ids in zip(names, found, strict=True):
                docs.append((name, place, 0))
                parts.append(ids)
                place += len(ids)
            ids = np.concatenate(parts)
            n = len(ids) // length
            if n:
                yield rows(ids, n)
            rest = ids[n * length :]
        if len(rest):
            yield rows(np.append(rest, np.full(length - len(rest), end, np.uint16)), 1)
        if at - began != counts.get(task, 0):
            raise ValueError("the input isn't what it was when its sequences were counted; give a table read from files")

    return run


def _write(root: str, per_shard: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, base = pafs.FileSystem.from_uri(root)
        stream = name = None
        done = -1

        def close() -> None:
            # A shard appears whole or not at all; a task that runs again replaces it.
            stream.close()
            files.move(f"{base}/{name}.{context.taskAttemptId()}", f"{base}/{name}")

        for batch in batches:
            for shard, slot, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "ids")), strict=True):
                if shard != done:
                    if stream is not None:
                        close()
                    name, done, expected = f"shard-{shard:08d}.bin", shard, shard * per_shard
                    stream = files.open_output_stream(f"{base}/{name}.{context.taskAttemptId()}")
                if slot != expected or len(ids) != stride:
                    raise ValueError(f"slot {slot} stands where {expected} belongs")
                stream.write(ids)
                expected += 1
            yield batch.select(["slot", "sequence_id", "doc_id", "start"])
        if stream is not None:
            close()

    return run


def write_shards(
    docs: DataFrame, root: str, tokenizer: tuple[str, str], end: int, text: str = "text", doc_id: str = "doc_id",
    length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 1,
) -> DataFrame:
    """Write all documents as shards under ``root`` and return the manifest written beside them.

    ``tokenizer`` is a file of byte-level ranks and its splitting pattern; ids have 16 bits, little
    end first, and ``end`` follows every document, an empty or null text included.  The last
    sequence of each task is filled up with ``end``.  ``root`` is a folder (path or URI) that all
    executors can write to.  The manifest has, per sequence, ``slot``, ``sequence_id``, and the
    document and id count at which it begins.  Repeated and null ids are like any others; a table
    without rows gives no shards.  ``docs`` has to be read from files, as it is read twice.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(text).alias("text"))
    counts = {r.task: r.n for r in rows.mapInArrow(_count(tokenizer, end, length), "task long, n long").collect()}
    first, size = {}, 0
    for task in sorted(counts):
        first[task] = size
        size += counts[task]
    files, base = pafs.FileSystem.from_uri(root)
    files.create_dir(base, recursive=True)
    found = rows.mapInArrow(
        _sequences(tokenizer, end, length, first, counts, size, key, per_shard),
        "shard int, slot long, sequence_id long, doc_id long, start long, ids binary",
    )
    placed = found.repartitionById(max(1, -(-size // per_shard)), F.col("shard")).sortWithinPartitions("shard", "slot")
    written = placed.mapInArrow(_write(root, per_shard, 2 * length), "slot long, sequence_id long, doc_id long, start long")
    written.write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def read_shards(spark: SparkSession, root: str, length: int = LENGTH, per_shard: int = PER_SHARD, start: int = 0) -> DataFrame:
    """(slot, ids) of all sequences from slot ``start`` on; a partition reads its shards in order."""
    files, base = pafs.FileSystem.from_uri(root)
    names = sorted(f.base_name for f in files.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith(".bin"))
    shards = [(int(n[6:-4]),) for n in names]
    shards = [s for s in shards if (s[0] + 1) * per_shard > start]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(root)
        stride, some = 2 * length, 256
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                with files.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
                    slot = max(start, shard * per_shard)
                    f.seek((slot - shard * per_shard) * stride)
                    while blob := f.read(some * stride):
                        n = len(blob) // stride
                        ids = [blob[i * stride : (i + 1) * stride] for i in range(n)]
                        yield pa.RecordBatch.from_arrays([pa.array(range(slot, slot + n), pa.int64()), pa.array(ids, pa.binary())], names=["slot", "ids"])
                        slot += n

    rows = spark.createDataFrame(shards, "shard int").repartition(max(1, len(shards)), "shard")
    return rows.mapInArrow(run, "slot long, ids binary")


def op3_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = scratch(spark, "token-shards")
    tokenizer = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    manifest = write_shards(documents(spark, sf_dir), root, tokenizer, end=50256)
    shards = read_shards(spark, root).select("slot", F.crc32("ids").alias("ids_crc32"), (F.length("ids") / 2).cast("int").alias("n_ids"))
    return manifest.join(shards, "slot").select(
        "slot", "sequence_id", (F.col("slot") / PER_SHARD).cast("long").alias("shard"),
        (F.pmod("slot", F.lit(PER_SHARD)) * 2 * LENGTH).alias("byte_offset"), "doc_id", "start", "n_ids", "ids_crc32",
    )
