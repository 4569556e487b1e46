"""Quality rules as weak supervision: rules vote or abstain, EM learns how far to trust them.

Every text is measured once; rules turn measures into votes (+1 good, -1 bad, 0 abstain).
The label model knows the votes by their patterns and counts only, of which there are at
most 3 ** rules however many documents there are, and expectation-maximisation on those
counts estimates each rule's accuracy on good and on bad documents.  A document is kept by
its posterior, not by passing every rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, empty_if_null, per_batch, stored
from .kernels import BYTE_VALUES, BYTES, IS_WORD, U64, WORDS, lines, mix, per_row, repeated, runs, slices, table, word_hashes

SYMBOLS = table(b"#*$%&|<>")
UPPER = table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = table(b"abcdefghijklmnopqrstuvwxyz")
SHOUTS = table(b"!")
DIGITS = table(b"0123456789")
ENDS = table(b".!?")
WINDOW = 5

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters",
    "n_shouts", "n_digits", "n_ends",
)


def measure_slice(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Every measure of the texts between consecutive offsets."""
    in_word = IS_WORD[data]
    starts, ends = runs(in_word, offsets)
    bounds = np.searchsorted(starts, offsets)
    out = {
        "n_words": np.diff(bounds),
        "word_chars": per_row(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_row(SYMBOLS[data], offsets),
        "n_upper": per_row(UPPER[data], offsets),
        "n_letters": per_row(UPPER[data] | LOWER[data], offsets),
        "n_shouts": per_row(SHOUTS[data], offsets),
        "n_digits": per_row(DIGITS[data], offsets),
        "n_ends": per_row(ENDS[data], offsets),
    }
    rows = len(offsets) - 1

    first, last, row = lines(data, offsets)
    worded = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_word, out=worded[1:])
    used = worded[last] > worded[first]
    first, last, row = first[used], last[used], row[used]
    out["n_lines"] = np.bincount(row, minlength=rows)
    prefix = BYTES.prefix(BYTE_VALUES[data])
    keys = BYTES.spans(prefix, first, last) ^ mix((last - first).astype(U64))
    keys = mix(keys + row.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, one = np.unique(keys, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(row[one], minlength=rows)

    hashes = BYTES.spans(prefix, starts, ends) ^ mix((ends - starts).astype(U64))
    word_row = np.repeat(np.arange(rows), np.diff(bounds))
    grams = WORDS.windows(WORDS.prefix(hashes), WINDOW)
    inside = word_row[: len(grams)] == word_row[WINDOW - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    twice = at[repeated(mix(grams[at] + word_row[at].astype(U64) * U64(0xD1342543DE82EF95)))]
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    out["n_repeat_words"] = per_row(np.cumsum(step[:-1]) > 0, bounds)
    return out


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = [measure_slice(data, offsets) for _, _, data, offsets in slices(batch.column("text"))]
    arrays = [pa.array(np.concatenate([p[m] for p in parts]).astype(np.int64)) for m in MEASURES]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *MEASURES])


def measures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The measures of every whole text, with its id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(text).alias("text"))
    return rows.mapInArrow(per_batch(_measure), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


@dataclass(frozen=True)
class Rule:
    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0).cast("int").alias(f"v_{self.name}")


def rules() -> list[Rule]:
    """Thresholds on shares of a text.

    Most rules know one fault and abstain without it, as a text free of one fault isn't good
    for that; one knows ordinary prose.
    """
    c, never = F.col, F.lit(False)
    words, letters = c("n_words"), c("n_letters")
    return [
        Rule("prose", (c("n_upper") * 5 <= letters) & (c("n_symbols") * 50 <= words) & (c("n_shouts") * 50 <= words), never),
        Rule("length", never, words < 10),
        Rule("word_size", never, (c("word_chars") < words * 2) | (c("word_chars") > words * 14)),
        Rule("symbols", never, c("n_symbols") * 10 > words),
        Rule("case", never, c("n_upper") * 3 > letters),
        Rule("shouting", never, c("n_shouts") * 10 > words),
        Rule("digits", never, c("n_digits") * 5 > c("word_chars")),
        Rule("lines", never, c("n_dup_lines") * 10 > c("n_lines") * 3),
        Rule("repetition", never, c("n_repeat_words") * 10 > words),
        Rule("sentences", never, (words >= 40) & (c("n_ends") * 100 < words)),
    ]


@dataclass(frozen=True)
class LabelModel:
    """What EM has found: the share of good documents, and each rule's vote chances by class."""

    prior: float
    good: np.ndarray  # rules x (bad, abstain, good): chances of the votes of a good document
    bad: np.ndarray

    def weights(self) -> np.ndarray:
        return np.log(self.good) - np.log(self.bad)

    def accuracy(self) -> np.ndarray:
        """Per rule, how often a vote (no abstention) is right."""
        right = self.prior * self.good[:, 2] + (1 - self.prior) * self.bad[:, 0]
        return right / (right + self.prior * self.good[:, 0] + (1 - self.prior) * self.bad[:, 2])


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, tolerance: float = 1e-7) -> LabelModel:
    """EM over vote patterns (-1, 0, 1 per rule) and how many documents show each.

    Starts from the votes, a complaint weighing more than praise, which also fixes which class
    is the good one.  No documents, or a single pattern, give a model that follows that start.
    """
    n = patterns.shape[1]
    seen = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    q = 1 / (1 + np.exp(-(2.0 - 4.0 * (patterns < 0).sum(axis=1) + 0.5 * (patterns > 0).sum(axis=1))))
    model = None
    for _ in range(rounds):
        w_good, w_bad = q * counts, (1 - q) * counts
        prior = (w_good.sum() + 1) / (counts.sum() + 2)
        # Pseudo-counts lean to a right vote, so that an unseen class can't turn a rule round.
        good = np.einsum("p,prv->rv", w_good, seen) + np.array([0.5, 1.0, 2.0])
        bad = np.einsum("p,prv->rv", w_bad, seen) + np.array([2.0, 1.0, 0.5])
        model = LabelModel(float(prior), good / good.sum(1, keepdims=True), bad / bad.sum(1, keepdims=True))
        score = np.log(model.prior / (1 - model.prior)) + np.einsum("rv,prv->p", model.weights(), seen)
        new = 1 / (1 + np.exp(-score))
        if len(q) == 0 or np.abs(new - q).max() < tolerance:
            break
        q = new
    assert model is not None and n
    return model


def posterior(model: LabelModel, used: list[Rule]) -> Column:
    """The chance that a document is good, from its vote columns."""
    score = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for rule, (bad, none, good) in zip(used, model.weights().tolist(), strict=True):
        vote = F.col(f"v_{rule.name}")
        score = score + F.when(vote < 0, bad).when(vote > 0, good).otherwise(none)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def judged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Per document its measures, votes, ``base_failed``, ``posterior`` and ``kept``.

    Words are runs without ASCII white space.  A null or empty text has no words and fails
    the base rules (fewer than ten words; over a fifth of the words in repeated windows), as
    does every text they name; all others are kept if the posterior reaches ``threshold``.
    Equal texts get equal results; repeated or null ids are documents of their own; a table
    without rows gives none; other columns are not read.
    """
    used = rules()
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = measures(docs, text, doc_id).withColumn("base_failed", failed)
    voted = stored(measured.select("*", *[r.vote() for r in used]), "quality-votes")
    names = [f"v_{r.name}" for r in used]
    # What the base rules drop is decided; its faults would otherwise be all that is learned.
    seen = voted.where(~F.col("base_failed")).groupBy(*names).count().collect()  # at most 3 ** rules rows
    patterns = np.array([[r[n] for n in names] for r in seen], int).reshape(len(seen), len(names))
    model = fit(patterns, np.array([r["count"] for r in seen], float))
    chance = posterior(model, used)
    return voted.withColumn("posterior", chance).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
