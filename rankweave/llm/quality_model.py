"""Quality classifier: hashed word and character n-gram vectors, averaged, then a softmax.

The vectors and the softmax layer are learned together by numpy stochastic gradient
descent from a bounded, class-balanced sample of labelled documents; the output is then
shifted to the class shares of all labelled documents.  Scoring reads every whole text where
it lies: since the document vector is an average, its product with the softmax weights is
the average of one number per n-gram, which is what the scorer looks up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, empty_if_null, fresh, key_of, portions, with_column
from .kernels import BYTE_VALUES, BYTES, IS_WORD, U64, mix, per_row, runs, slices


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dimension: int = 16
    # Bytes of the character n-grams inside a word.
    grams: tuple[int, ...] = (3, 4)
    # The bound of the labelled sample, per class.
    sample_per_class: int = 1500
    epochs: int = 4
    rate: float = 0.5
    batch: int = 32
    seed: int = 11
    slice_bytes: int = 1 << 18


def features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, bounds of each text's) of words and of each n-gram size, in text order."""
    mask = U64(s.buckets - 1)
    prefix = BYTES.prefix(BYTE_VALUES[data])
    starts, ends = runs(IS_WORD[data], offsets)
    words = BYTES.spans(prefix, starts, ends) ^ mix((ends - starts).astype(U64))
    out = [((words & mask).astype(np.int32), np.searchsorted(starts, offsets))]
    left = np.zeros(len(data), np.int32)  # bytes from here to the end of the word
    left[starts] = ends - starts
    within = np.repeat(ends, ends - starts)
    at = np.flatnonzero(IS_WORD[data])
    left[at] = within - at
    for n in s.grams:
        use = np.flatnonzero(left >= n)
        grams = (BYTES.windows(prefix, n)[use] + U64(n)) * U64(0x9E3779B97F4A7C15)
        out.append(((grams >> U64(40) & mask).astype(np.int32), np.searchsorted(use, offsets)))
    return out


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # buckets x dimension
    weights: np.ndarray  # dimension x 2, columns: label 0, label 1
    bias: np.ndarray

    def values(self) -> np.ndarray:
        """What each bucket adds to the difference of the two outputs."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> Model:
    """``texts``: per document its distinct buckets and their shares, which sum to 1."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1, 1, (s.buckets, s.dimension)) / s.dimension
    weights, bias = np.zeros((s.dimension, 2)), np.zeros(2)
    steps = max(1, s.epochs * -(-len(texts) // s.batch))
    step = 0
    for _ in range(s.epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), s.batch):
            rate = s.rate * (1 - step / steps)
            step += 1
            some = [i for i in order[at : at + s.batch] if len(texts[i][0])]
            if not some:
                continue
            ids = np.concatenate([texts[i][0] for i in some])
            shares = np.concatenate([texts[i][1] for i in some])
            sizes = np.array([len(texts[i][0]) for i in some])
            begin = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(vectors[ids] * shares[:, None], begin)
            logits = hidden @ weights + bias
            chances = np.exp(logits - logits.max(1, keepdims=True))
            chances /= chances.sum(1, keepdims=True)
            chances[np.arange(len(some)), labels[some]] -= 1
            back = chances @ weights.T
            weights -= rate * hidden.T @ chances
            bias -= rate * chances.mean(0)
            # Rows of one bucket add up; each text moves its buckets by their shares.
            push = np.repeat(back, sizes, axis=0) * (shares * np.repeat(sizes, sizes) ** 0.5)[:, None]
            sort = np.argsort(ids, kind="stable")
            new = np.flatnonzero(np.append(True, np.diff(ids[sort]) > 0))
            vectors[ids[sort][new]] -= rate * np.add.reduceat(push[sort], new)
    return Model(vectors, weights, bias)


def _fit(s: Settings, text: str, label: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            labels += batch.column(label).to_pylist()
            for _, _, data, offsets in slices(batch.column(text), s.slice_bytes):
                parts = features(data, offsets, s)
                for i in range(len(offsets) - 1):
                    ids = np.concatenate([b[bounds[i] : bounds[i + 1]] for b, bounds in parts])
                    ids, counts = np.unique(ids, return_counts=True)
                    texts.append((ids, counts / max(1, counts.sum())))
        model = train(texts, np.array(labels, int), s)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a.tobytes()]) for a in (model.vectors, model.weights, model.bias)], names=["vectors", "weights", "bias"]
        )

    return run


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", s: Settings = Settings()) -> Model:
    """The model learned from documents with a label and outside the held-out fold.

    Of each class the ``sample_per_class`` smallest by a hash of the id are used, so the one
    task that trains gets a bounded number of rows.  If only one class is labelled, or none, or
    no labelled document is in ``docs``, every score is the share of class 1, smoothed.
    """
    known = labels.where(~held_out(doc_id) & F.col(label).isin(0, 1)).select(
        key_of(doc_id).alias("k"), F.col(label).cast("int").alias("y")
    ).groupBy("k").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    bias = np.log([counts.get(0, 0) + 0.5, counts.get(1, 0) + 0.5])
    shape = (s.buckets, s.dimension)
    if len(counts) < 2:
        return Model(np.zeros(shape), np.zeros((s.dimension, 2)), bias)
    order = F.xxhash64("k"), F.col("k")
    picks = [known.where(F.col("y") == y).orderBy(*order).limit(s.sample_per_class) for y in (0, 1)]
    picked = picks[0].unionByName(picks[1])  # at most 2 * sample_per_class pairs of numbers
    rows = docs.select(key_of(doc_id).alias("k"), empty_if_null(text).alias("text")).join(F.broadcast(picked), "k")
    row = (
        rows.select("text", "y").repartition(1).sortWithinPartitions("y", F.xxhash64("text"))
        .mapInArrow(_fit(s, "text", "y"), "vectors binary, weights binary, bias binary").first()
    )
    if row is None:  # no labelled document is there
        return Model(np.zeros(shape), np.zeros((s.dimension, 2)), bias)
    learned = [np.frombuffer(row[c]) for c in ("vectors", "weights", "bias")]
    used = np.log([min(counts[y], s.sample_per_class) for y in (0, 1)])
    return Model(learned[0].reshape(shape), learned[1].reshape(-1, 2), learned[2] + bias - used)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score", s: Settings = Settings()) -> DataFrame:
    """``docs`` with the chance of label 1 as ``column``; nothing but the text is looked at.

    A null or empty text gets the score of an average of nothing, which is the bias alone.
    Equal texts get equal scores.  Other columns pass through; no rows give no rows.
    """
    values, bias = model.values(), float(model.bias[1] - model.bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            parts = []
            for _, _, data, offsets in slices(batch.column(text), s.slice_bytes):
                total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
                for buckets, bounds in features(data, offsets, s):
                    total += per_row(values[buckets].astype(float), bounds)
                    n += np.diff(bounds)
                parts.append(1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias))))
            found = np.concatenate(parts) if parts else np.zeros(0)
            yield with_column(batch, column, pa.array(found))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != column)
    return docs.drop(column).mapInArrow(run, f"{kinds}, `{column}` double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns."""
    name = fresh(docs, "_score")
    return score(docs, fit(docs, labels), column=name).where(F.col(name) >= threshold).drop(name)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
