"""Toxicity: a factorization machine over hashed terms.

Every word of a document (lower-cased, ``\\w+``) is hashed to one of ``buckets`` terms; a
document is the set of its terms, each with the value 1/sqrt(number of terms) (``power``).  The model
is ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``: besides a weight per term, every term
has a short vector, and two terms that appear together add the product of their vectors, so
an insult next to a group mention can count for more than the two alone.

Training is numpy stochastic gradient descent (plain steps, logistic loss) in one task on a
bounded, class-balanced sample of labelled documents (``sample_per_class`` per class, the
smallest by a hash of the id); the output is then shifted to the class shares of all
labelled documents.  Term sets are made where the texts lie; only term ids reach the
training task, and a document never has more than ``buckets`` of them.  Scoring reads every
whole text where it lies, word by word, with the model broadcast (its size is fixed by
``buckets`` and ``factors``, not by the data).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, empty_if_null, fresh, key_of, portions, with_column

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    factors: int = 8
    # The bound of the labelled sample, per class.
    sample_per_class: int = 4000
    epochs: int = 10
    rate: float = 2.0
    l2: float = 1e-4
    seed: int = 5
    # A term's value: 1/number_of_terms ** power (0: presence alone, 0.5: unit length).
    power: float = 0.5


def terms(text: str | None, s: Settings) -> np.ndarray:
    """The distinct term ids of a text, sorted; none for a null or empty text.

    The text is read word by word, so a long one costs the size of its term set only.
    """
    if not text:
        return np.zeros(0, np.int32)
    seen = set()
    for m in WORD.finditer(text):
        seen.add(xxhash.xxh64_intdigest(m.group().lower(), s.seed) % s.buckets)
    return np.fromiter(sorted(seen), np.int32, len(seen))


@dataclass(frozen=True)
class Model:
    bias: float
    power: float
    weights: np.ndarray  # buckets
    vectors: np.ndarray  # buckets x factors

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The model output of each document; its terms are ``ids[bounds[i]:bounds[i+1]]``."""
        n = np.diff(bounds)
        x = np.maximum(n, 1) ** -self.power
        rows = np.repeat(np.arange(len(n)), n)
        linear = np.bincount(rows, self.weights[ids], len(n)) * x
        v = self.vectors[ids]
        total = np.zeros((len(n), v.shape[1]))
        np.add.at(total, rows, v)
        squares = np.bincount(rows, (v * v).sum(1), len(n))
        pairs = 0.5 * x * x * ((total * total).sum(1) - squares)
        return self.bias + linear + pairs


def train(docs: list[np.ndarray], labels: np.ndarray, s: Settings) -> Model:
    """Logistic loss, one document a step, a rate that falls linearly; ``docs`` are term id sets.

    Plain steps, not per-term rates: a term seen in many documents moves more than one seen
    in a few, which keeps the model off the rare terms of single documents.
    """
    rng = np.random.default_rng(s.seed)
    w0, w = 0.0, np.zeros(s.buckets)
    v = rng.normal(0, 0.01, (s.buckets, s.factors))
    steps, step = max(1, s.epochs * len(docs)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(docs)):
            rate = s.rate * (1 - step / steps)
            step += 1
            ids = docs[i]
            x = max(len(ids), 1) ** -s.power
            vi = v[ids]
            total = vi.sum(0) * x
            y = w0 + w[ids].sum() * x + 0.5 * (total @ total - (vi * vi).sum() * x * x)
            g = 1 / (1 + np.exp(-y)) - labels[i]
            w0 -= rate * g
            if not len(ids):
                continue
            w[ids] -= rate * (g * x + s.l2 * w[ids])
            v[ids] -= rate * (g * x * (total[None, :] - vi * x) + s.l2 * vi)
    return Model(w0, s.power, w.astype(np.float32), v.astype(np.float32))


def _term_lists(s: Settings, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            found = [terms(t, s) for t in batch.column(text).to_pylist()]
            yield with_column(batch.drop_columns([text]), "terms", pa.array(found, pa.list_(pa.int32())))

    return run


def _fit(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels = [], []
        for batch in batches:
            labels += batch.column("y").to_pylist()
            docs += [np.asarray(t, np.int64) for t in batch.column("terms").to_pylist()]
        model = train(docs, np.array(labels, float), s)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.bias]), pa.array([model.weights.tobytes()]), pa.array([model.vectors.tobytes()])],
            names=["bias", "weights", "vectors"],
        )

    return run


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", s: Settings = Settings()) -> Model:
    """The model learned from documents with a 0/1 label outside the held-out fold.

    Labels of a repeated id: the largest counts.  Labels other than 0 and 1, and null ids, are
    not read.  A repeated document id gives all its texts the label.  If only one class is
    labelled, or none, or no labelled document is in ``docs``, every score is the share of
    class 1, smoothed.
    """
    known = (
        labels.where(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .select(key_of(doc_id).alias("k"), F.col(label).cast("int").alias("y"))
        .groupBy("k").agg(F.max("y").alias("y"))
    )
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # two rows at most
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    empty = Model(prior, s.power, np.zeros(s.buckets, np.float32), np.zeros((s.buckets, s.factors), np.float32))
    if len(counts) < 2:
        return empty
    order = F.xxhash64("k"), F.col("k")
    picks = [known.where(F.col("y") == y).orderBy(*order).limit(s.sample_per_class) for y in (0, 1)]
    picked = picks[0].unionByName(picks[1])  # at most 2 * sample_per_class pairs of numbers
    rows = docs.select(key_of(doc_id).alias("k"), empty_if_null(text).alias("text")).join(F.broadcast(picked), "k")
    lists = rows.select("y", "text").mapInArrow(_term_lists(s, "text"), "y int, terms array<int>")
    row = lists.repartition(1).sortWithinPartitions("y", F.xxhash64("terms")).mapInArrow(
        _fit(s), "bias double, weights binary, vectors binary"
    ).first()
    if row is None:
        return empty
    used = float(np.log(min(counts[1], s.sample_per_class) / min(counts[0], s.sample_per_class)))
    return Model(
        row.bias + prior - used,
        s.power,
        np.frombuffer(row.weights, np.float32),
        np.frombuffer(row.vectors, np.float32).reshape(s.buckets, s.factors),
    )


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score", s: Settings = Settings()) -> DataFrame:
    """``docs`` with the chance of label 1 as ``column``; nothing but the text is looked at.

    A null or empty text has no terms and gets the bias alone.  Equal texts get equal scores;
    repeated rows are scored each.  Other columns pass through, and a column already named
    ``column`` is replaced.  No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in portions(batches, text):
            found = [terms(t, s) for t in batch.column(text).to_pylist()]
            bounds = np.zeros(len(found) + 1, np.int64)
            np.cumsum([len(f) for f in found], out=bounds[1:])
            ids = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
            chance = 1 / (1 + np.exp(-m.logits(ids, bounds)))
            yield with_column(batch, column, pa.array(chance, pa.float64()))

    kept = docs.drop(column)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{kinds}, `{column}` double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose toxicity stays below ``threshold``, with their columns."""
    name = fresh(docs, "_toxic")
    return score(docs, fit(docs, labels), column=name).where(F.col(name) < threshold).drop(name)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
