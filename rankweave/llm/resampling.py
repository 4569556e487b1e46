"""Importance resampling towards a target distribution of hashed n-grams.

Features of a text are all runs of 1 to 3 consecutive words, joined by one space; each has a
bucket, the unsigned crc32 of its UTF-8 bytes modulo ``BUCKETS``.  Counts per bucket are
taken over all documents and over the target texts (``benchmark``); a bucket's gain is the
log ratio of the two smoothed shares, in thousandths, and a document's weight is the sum of
the gains of its features.  Adding Gumbel noise keyed by the document id and taking the
highest scores draws documents without replacement in proportion to exp(weight / 1000).

Inside a task the words of a portion of text are interned in an open-addressed numpy table by
their xxhash64, verified against the word itself; a slot holds the word's crc32 and length.
The crc32 of a 2- or 3-gram is joined from that of the n-gram before and its last word's, by
byte tables for each length, for all occurrences at once.  Counts leave a task as at most ``BUCKETS`` rows; the gains come back as a
broadcast array of ``BUCKETS`` integers.  The draw ranks by a range partition of the
scores and per-partition offsets, so no task sees more than its range.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, portions, stored

# Fixed values of the contract: word characters, bucket count, seed text and share drawn.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BUCKETS = 10_000
ORDERS = (1, 2, 3)
SEED_TEXT = "42:"
PERCENT = 5
MIN_WORDS = 20

PIECE_WORDS = 1 << 18
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Open addressing with linear probing over 64-bit keys.

    ``intern(keys, same)`` gives every occurrence the slot of its value: a slot is taken by
    the first occurrence that finds it empty, and a later one settles there only if its key is
    equal and ``same(occurrences, first_occurrences)`` says the values are; else it probes on.
    """

    def __init__(self, n: int):
        size = 1 << max(4, int(2 * max(n, 1) - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)
        self.first = np.full(size, -1, np.int64)

    def intern(self, keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        slot = np.full(len(keys), -1, np.int64)
        at = ((keys * GOLDEN) >> np.uint64(20)) & self.mask
        pending = np.arange(len(keys))
        while len(pending):
            where = at[pending].astype(np.int64)
            empty = self.first[where] < 0
            taken, first = np.unique(where[empty], return_index=True)
            winners = pending[empty][first]
            self.keys[taken], self.first[taken], slot[winners] = keys[winners], winners, taken
            rest = pending[slot[pending] < 0]
            where = at[rest].astype(np.int64)
            hit = self.keys[where] == keys[rest]
            ok = np.zeros(len(rest), bool)
            if hit.any():
                ok[hit] = same(rest[hit], self.first[where[hit]])
            slot[rest[ok]] = where[ok]
            pending = rest[~ok]
            at[pending] = (at[pending] + np.uint64(1)) & self.mask
        return slot


# Word bytes once A-Z are lowered: digits, a-z and every byte of a non-ASCII character.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CHUNK_BYTES = 1 << 20


def _chunks(text: str) -> Iterator[bytes]:
    """The lowered UTF-8 bytes of a text in parts of about CHUNK_BYTES, cut between words."""
    data = text.encode().translate(LOWER_BYTES)
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        if end < len(data) and WORD_BYTES.match(data, end - 1, end):
            inside = WORD_BYTES.match(data, end)
            if inside:  # the cut is inside a word (or a character): move it to the word's end
                end = inside.end()
        yield data[at:end]
        at = end


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(row of each word, words, whether the word is new) over bounded pieces of text.

    A document may span pieces: a piece then starts with the two words before it again, not
    new, so that the n-grams ending in its first words are whole.
    """
    rows: list[np.ndarray] = []
    words: list[bytes] = []
    new: list[np.ndarray] = []
    held = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        for chunk in _chunks(text):
            found = WORD_BYTES.findall(chunk)
            rows.append(np.full(len(found), row))
            new.append(np.ones(len(found), bool))
            words += found
            held += len(found)
            if held >= PIECE_WORDS:
                r, n = np.concatenate(rows), np.concatenate(new)
                yield r, words, n
                keep = [i for i in (-2, -1) if len(r) >= -i and r[i] == row]
                rows, words, new = [np.full(len(keep), row)], [words[i] for i in keep], [np.zeros(len(keep), bool)]
                held = len(keep)
    if words:
        yield np.concatenate(rows), words, np.concatenate(new)


def _zero_byte(c: int) -> int:
    """The CRC-32 register after one more zero byte (reflected polynomial)."""
    for _ in range(8):
        c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
    return c


def _shift_tables(levels: int = 40) -> np.ndarray:
    """For k < levels, byte tables of the linear map 'append 2^k zero bytes' on CRC values."""
    images = [_zero_byte(1 << i) for i in range(32)]
    out = np.zeros((levels, 4, 256), np.uint32)
    values = np.arange(256)
    for k in range(levels):
        for j in range(4):
            for t in range(8):
                out[k, j] ^= np.where((values >> t) & 1, np.uint32(images[8 * j + t]), np.uint32(0))
        images = [int(_apply(out[k], np.array([v], np.uint32))[0]) for v in images]
    return out


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 255] ^ table[1][(v >> 8) & 255] ^ table[2][(v >> 16) & 255] ^ table[3][v >> 24]


SHIFTS = _shift_tables()
SPACE_CRC = np.uint32(zlib.crc32(b" "))


def _shifted(v: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC values after so many zero bytes more."""
    out = v.astype(np.uint32)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        at = np.flatnonzero((zeros >> k) & 1)
        out[at] = _apply(SHIFTS[k], out[at])
    return out


# For second texts of up to SHORT - 1 bytes: byte tables that append a space and the text, and the space's part.
SHORT = 64
JOINS = np.concatenate([
    _shifted(np.arange(256, dtype=np.uint32) << np.uint32(8 * j), np.full(256, size + 1)) for size in range(SHORT) for j in range(4)
])
SPACES = _shifted(np.full(SHORT, SPACE_CRC), np.arange(SHORT))


def crc_join(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """crc32 of first-text + ' ' + second-text from the crc32 of each and the second's length."""
    v, size = first.astype(np.uint32), np.minimum(second_bytes, SHORT - 1)
    at = size * 1024
    out = JOINS[at + (v & 255)]
    for j in (1, 2, 3):
        out ^= JOINS[at + (256 * j) + ((v >> np.uint32(8 * j)) & 255)]
    out ^= SPACES[size]
    long = np.flatnonzero(second_bytes >= SHORT)
    if len(long):
        spaced = _shifted(v[long], np.ones(len(long), np.int64)) ^ SPACE_CRC
        out[long] = _shifted(spaced, second_bytes[long])
    return out ^ second.astype(np.uint32)


def features(rows: np.ndarray, words: list[bytes], new: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram that ends in a new word, by order of n."""
    text = np.empty(len(words), dtype=object)
    text[:] = words
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    table = Table(len(words))
    wid = table.intern(keys, lambda a, b: text[a] == text[b])
    # A word's slot keeps its crc and byte length, computed once per distinct word.
    distinct = np.flatnonzero(table.first >= 0)
    crc, size = np.zeros(len(table.first), np.uint32), np.zeros(len(table.first), np.int64)
    crc[distinct] = np.fromiter((zlib.crc32(text[i]) for i in table.first[distinct]), np.uint32, len(distinct))
    size[distinct] = np.fromiter((len(text[i]) for i in table.first[distinct]), np.int64, len(distinct))
    crc, size = crc[wid], size[wid]
    # The crc of the n-gram that ends in each word; n-grams over two texts are made, and dropped below.
    value = crc
    for n in ORDERS:
        if n > 1:
            value = crc_join(value[:-1], crc[n - 1 :], size[n - 1 :])
        ends = np.arange(n - 1, len(words))
        whole = new[ends] & (rows[ends - n + 1] == rows[ends])
        yield rows[ends[whole]], (value[whole] % np.uint32(BUCKETS)).astype(np.int64)
        if len(words) == n:
            # No longer n-grams; readers still get one part for every n.
            for _ in ORDERS[n:]:
                yield rows[:0], np.zeros(0, np.int64)
            return


def _counts(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in portions(batches, text):
            for rows, words, new in pieces(batch.column(text).to_pylist()):
                for _, bucket in features(rows, words, new):
                    total += np.bincount(bucket, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Feature counts per bucket over all ``texts``; at most ``BUCKETS`` rows reach the driver."""
    summed = texts.select(text).mapInArrow(_counts(text), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in summed.collect():
        out[r.bucket] = r.n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) per bucket, in doubles."""
    s, t = docs.astype(float), target.astype(float)
    big_s, big_t = float(docs.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (big_s + BUCKETS) / ((s + 1) * (big_t + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_features and weight (long) for every row.

    A null or empty text has no words, no features and weight 0.  Other columns pass through;
    columns of those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    names = ("n_words", "n_features", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in portions(batches, text):
            n = batch.num_rows
            words, grams, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for rows, ws, new in pieces(batch.column(text).to_pylist()):
                words += np.bincount(rows[new], minlength=n)
                for at, bucket in features(rows, ws, new):
                    grams += np.bincount(at, minlength=n)
                    # Sums of a piece's integers are far below 2^53, so they are exact as doubles.
                    weight += np.bincount(at, g[bucket], minlength=n).astype(np.int64)
            arrays = [*batch.columns, pa.array(words), pa.array(grams), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names])

    kept = docs.drop(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{kinds}, n_words long, n_features long, weight long")


def noise(doc_id: str):
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits of sha256('42:<id>').

    A null id is written as nothing: '42:'.
    """
    key = F.concat(F.lit(SEED_TEXT), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, eligible: str, order: list, column: str = "rank") -> DataFrame:
    """``scored`` with ``column``: 1, 2, ... by ``order`` for the first floor(5 N / 100) of the N
    eligible rows, null for all others.

    Eligible rows are range-partitioned by ``order`` and numbered inside their partition; the
    partition sizes (one row per partition) give each partition its first rank.
    """
    spark = scored.sparkSession
    pid, at = fresh(scored, "_part"), fresh(scored, "_at")
    chosen = scored.where(F.col(eligible))
    sorted_ = chosen.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(sorted_.withColumn(pid, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "ranked")
    sizes = numbered.groupBy(pid).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    before, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r[pid]):
        offsets.append((r[pid], before))
        before += r.n
    draw = before * PERCENT // 100
    starts = spark.createDataFrame(offsets or [(0, 0)], f"`{pid}` int, start long")
    # The id of a row is its partition shifted by 33 bits plus its place there.
    local = F.col(at) - F.shiftleft(F.col(pid).cast("long"), 33)
    out = numbered.join(F.broadcast(starts), pid).withColumn(column, F.col("start") + local + 1)
    out = out.withColumn(column, F.when(F.col(column) <= draw, F.col(column))).drop(pid, at, "start")
    rest = scored.where(~F.col(eligible)).withColumn(column, F.lit(None).cast("long"))
    return out.unionByName(rest)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    weighed = stored(weigh(docs, gain).withColumn("score", (F.col("weight") + noise("doc_id")).cast("long")).drop("text"), "weighed")
    weighed = weighed.withColumn("eligible", F.col("n_words") >= MIN_WORDS)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    out = ranked(weighed, "eligible", order)
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
