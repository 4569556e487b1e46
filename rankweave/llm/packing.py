"""Cost-balanced packing of tokenised documents into training sequences.

Tokenising and packing happen where a document is read, in groups of bounded size, so
nothing is shuffled and no group grows with the corpus.  Within a group documents are
taken in descending length; each goes to the sequence of lowest estimated cost that has
room, where a piece of n tokens costs n + quadratic * n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, empty_if_null
from .tokens import WordEncoder

CAPACITY = 4096
END = 2
# Documents are packed together until they fill so many sequences.
GROUP_SEQUENCES = 256
# Sequences of one task are numbered from its partition number times this.
TASK_STRIDE = 1 << 32

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, capacity long, cost double"
)


def tail_sizes(rest: int, capacity: int) -> list[int]:
    """Sequence lengths for tokens that fill no whole sequence: powers of two need no padding."""
    return [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: np.ndarray, sizes: np.ndarray, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill ``sizes`` exactly.

    ``sizes`` sum to at least ``lengths``.  A document is cut only if it fits nowhere whole.
    """
    room = np.array(sizes, np.int64)
    used = np.zeros(len(sizes), np.int64)
    cost = np.zeros(len(sizes))
    out = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, int(used[seq])))
        used[seq] += n
        room[seq] -= n
        cost[seq] += n + quadratic * n * n

    for doc in np.lexsort((np.arange(len(lengths)), -lengths)):
        start, left = 0, int(lengths[doc])
        while left:
            fits = np.flatnonzero(room >= left)
            if len(fits):
                put(int(doc), start, left, int(fits[np.argmin(cost[fits])]))
                break
            # The roomiest sequence takes what it can; of several, the cheapest.
            wide = np.flatnonzero(room == room.max())
            seq = int(wide[np.argmin(cost[wide])])
            n = int(room[seq])
            put(int(doc), start, n, seq)
            start, left = start + n, left - n
    return out


def _pack(tokenizer: str, capacity: int, group: int, quadratic: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(tokenizer)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) * TASK_STRIDE
        held: list[tuple[int, np.ndarray, int, int]] = []  # id, all ids, and which of them wait
        total = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, sequence, total
            whole, spare = divmod(total, capacity)
            sizes, rest = [capacity] * whole, []
            if last:
                sizes += tail_sizes(spare, capacity)
            else:
                while spare:  # less than a sequence waits for the next group
                    doc, ids, low, high = held.pop()
                    cut = max(low, high - spare)
                    rest.append((doc, ids, cut, high))
                    spare -= high - cut
                    if cut > low:
                        held.append((doc, ids, low, cut))
                rest.reverse()
            rows: dict[str, list] = {f.split()[0]: [] for f in PIECES.split(", ")}
            lengths = np.array([high - low for _, _, low, high in held], np.int64)
            for i, start, n, seq, offset in assign(lengths, sizes, quadratic):
                doc, ids, low, _ = held[i]
                piece = ids[low + start : low + start + n].astype("<u4").tobytes()
                values = (doc, low + start, n, piece, len(ids), sequence + seq, offset, sizes[seq], n + quadratic * n * n)
                for column, value in zip(rows.values(), values, strict=True):
                    column.append(value)
            sequence += len(sizes)
            held, total = rest, sum(high - low for _, _, low, high in rest)
            kinds = {"ids": pa.binary(), "cost": pa.float64()}
            arrays = [pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()]
            return pa.RecordBatch.from_arrays(arrays, names=list(rows))

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode.many(batch.column("text"), END), strict=True):
                held.append((doc, ids, 0, len(ids)))
                total += len(ids)
                if total >= group * capacity:
                    yield flush(last=False)
            pa.default_memory_pool().release_unused()
        if held:
            yield flush(last=True)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    group_sequences: int = GROUP_SEQUENCES,
    quadratic: float = 1 / CAPACITY,
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` tokens.

    ``tokenizer`` is the path of a tokenizer file that drops white space.  A document is its
    ids and then id 2, so a null or empty text is one token.  ``ids`` are little-endian
    32-bit; ``capacity`` of a row is the length its sequence is filled to: that of the call, or
    a power of two for the last of a task.  ``sequence_id`` is unique; it depends on the
    partition a document is read in.  Repeated and null ids are packed like any others; a
    table without rows gives none; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(text).alias("text"))
    return rows.mapInArrow(_pack(tokenizer, capacity, group_sequences, quadratic), PIECES)


def pieces(docs: DataFrame) -> DataFrame:
    """Packed pieces with the public word tokenizer, and the checksum of each in place of its ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "capacity", "cost"
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pieces(documents(spark, sf_dir))
