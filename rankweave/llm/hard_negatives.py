"""Hard-negative mining with LEMP-style coordinate pruning.

Rows (vectors quantised to integers, floor(256 x)) are split into shards of bounded size,
anchors (vec_id divisible by 100) into blocks of bounded size; every (shard, block) pair is
one task, so all anchors meet all rows, in blocks.  Inside a task the shard is indexed as
LEMP does: rows sorted by length and cut into length buckets, and in each bucket one sorted
list of unit-vector values per coordinate.  For an anchor ``a`` with a score threshold
``t > 0`` a bucket whose longest row ``L`` has ``|a| L < t`` is skipped with all shorter ones;
otherwise every row ``p`` that can reach ``t`` has cosine at least ``t / (|a| L)``, which
bounds each of its unit coordinates to a range around the anchor's; the rows inside the
ranges of the anchor's largest ("focus") coordinates, found by binary search in the sorted
lists and intersected, are the only candidates, and their exact integer products decide.

Two passes: the first finds each anchor's positives (top ``POSITIVES`` of its label, the
threshold being the running k-th score), the second its negatives for every positive (top
``NEGATIVES`` of other labels in [0.3, 0.9] of the positive's score, the threshold being
the smallest lower end still open).  Each task keeps a per-anchor top list; a window over
the few rows per anchor from all shards gives the final lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import stored

# Fixed values of the contract.
ANCHOR_EVERY = 100
RELABEL_EVERY = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score

# Sizes of the work, not of the result.
SHARD_ROWS = 50_000
BLOCK_ANCHORS = 2_000
BUCKET_ROWS = 512
FOCUS = 3
EPS = 1e-9
LAST = np.iinfo(np.int64).max


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, q (the integer vector), key (a hash of all three) of the rows that take part.

    A row takes part if its vec_id, label and vector are not null and every component is
    finite; labels of ids divisible by 7 become (label + 1) % 10 first.
    """
    vec = F.col("embedding")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    valid = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & finite)
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    q = F.transform(vec, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    out = valid.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), q.alias("q"))
    return out.withColumn("key", F.xxhash64("vec_id", "label", "q"))


class Index:
    """A shard sorted by length, cut into buckets, with sorted unit coordinates per bucket."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, keys: np.ndarray, vecs: np.ndarray):
        norms = np.sqrt((vecs.astype(float) ** 2).sum(1)) if len(vecs) else np.zeros(0)
        order = np.argsort(-norms, kind="stable")
        self.ids, self.labels, self.keys, self.vecs, self.norms = ids[order], labels[order], keys[order], vecs[order], norms[order]
        unit = self.vecs / np.maximum(self.norms, 1e-300)[:, None] if len(vecs) else np.zeros((0, 0))
        self.buckets = []
        for s in range(0, len(order), BUCKET_ROWS):
            e = min(s + BUCKET_ROWS, len(order))
            by = np.argsort(unit[s:e], axis=0, kind="stable")
            self.buckets.append((s, e, float(self.norms[s]), np.take_along_axis(unit[s:e], by, 0).T.copy(), by.T.copy()))

    def search(self, a: np.ndarray, keeper) -> None:
        """Offers ``keeper`` every row that can reach its threshold, bucket by bucket."""
        size = math.sqrt(float((a.astype(float) ** 2).sum()))
        unit = a / size if size > 0 else a.astype(float)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for s, e, longest, values, rows in self.buckets:
            t = keeper.threshold()
            if t == math.inf:
                return
            if t is not None and t > 0 and size * longest < t * (1 - EPS):
                return  # this bucket and all shorter ones can't reach it
            if t is None or t <= 0 or size == 0 or longest == 0:
                found = np.arange(s, e)
            else:
                tb = min(1.0, t / (size * longest))
                found = None
                for f in focus:
                    # Angles: the row's within arccos(tb) of the anchor's; past a pole the range is open.
                    r = math.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - tb * tb)))
                    lo = -2.0 if unit[f] <= -tb + EPS else unit[f] * tb - r - EPS
                    hi = 2.0 if unit[f] >= tb - EPS else unit[f] * tb + r + EPS
                    i, j = np.searchsorted(values[f], [lo, hi], side="left")[0], np.searchsorted(values[f], hi, side="right")
                    part = rows[f][i:j]
                    found = part if found is None else np.intersect1d(found, part, assume_unique=True)
                    if not len(found):
                        break
                found = np.sort(found) + s
            if len(found):
                keeper.offer(found, self.vecs[found] @ a)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` by score descending, then id ascending."""
    order = np.lexsort((ids, -scores))
    return order[:k]


class Positives:
    """The first POSITIVES rows of the anchor's label other than the anchor."""

    def __init__(self, index: Index, label: int, vec_id: int, key: int):
        self.index, self.label, self.vec_id, self.key = index, label, vec_id, key
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def threshold(self):
        return float(self.scores[-1]) if len(self.rows) >= POSITIVES else None

    def offer(self, rows: np.ndarray, scores: np.ndarray) -> None:
        ix = self.index
        keep = (ix.labels[rows] == self.label) & ~((ix.ids[rows] == self.vec_id) & (ix.keys[rows] == self.key))
        rows, scores = np.concatenate([self.rows, rows[keep]]), np.concatenate([self.scores, scores[keep]])
        best = _best(ix.ids[rows], scores, POSITIVES)
        self.rows, self.scores = rows[best], scores[best]


class Negatives:
    """For each positive, the first NEGATIVES rows of other labels inside its score range."""

    def __init__(self, index: Index, label: int, positive_scores: list[int]):
        self.index, self.label = index, label
        self.ranges = [(-((-LOW * p) // 100), (HIGH * p) // 100) for p in positive_scores]
        self.rows = [np.zeros(0, np.int64) for _ in positive_scores]
        self.scores = [np.zeros(0, np.int64) for _ in positive_scores]

    def threshold(self):
        open_ = [max(lo, self.scores[j][-1]) if len(self.rows[j]) >= NEGATIVES else lo for j, (lo, hi) in enumerate(self.ranges) if lo <= hi]
        return float(min(open_)) if open_ else math.inf

    def offer(self, rows: np.ndarray, scores: np.ndarray) -> None:
        ix = self.index
        other = ix.labels[rows] != self.label
        rows, scores = rows[other], scores[other]
        for j, (lo, hi) in enumerate(self.ranges):
            inside = (scores >= lo) & (scores <= hi)
            if lo > hi or not inside.any():
                continue
            r, s = np.concatenate([self.rows[j], rows[inside]]), np.concatenate([self.scores[j], scores[inside]])
            best = _best(ix.ids[r], s, NEGATIVES)
            self.rows[j], self.scores[j] = r[best], s[best]


def _index(rows: pd.DataFrame) -> Index:
    vecs = np.array(rows["q"].tolist(), dtype=np.int64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.int64)
    return Index(rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), rows["key"].to_numpy(np.int64), vecs)


POSITIVE_ROWS = "anchor_id long, anchor_key long, positive_id long, positive_score long"
NEGATIVE_ROWS = "anchor_id long, anchor_key long, positive_id long, positive_score long, negative_id long, negative_score long"


def _positives(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    index, out = _index(rows), []
    for a in anchors.itertuples(index=False):
        keeper = Positives(index, a.label, a.vec_id, a.key)
        index.search(np.asarray(a.q, np.int64), keeper)
        out += [(a.vec_id, a.key, int(index.ids[r]), int(s)) for r, s in zip(keeper.rows, keeper.scores)]
    return pd.DataFrame(out, columns=["anchor_id", "anchor_key", "positive_id", "positive_score"])


def _negatives(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    index, out = _index(rows), []
    for a in anchors.itertuples(index=False):
        keeper = Negatives(index, a.label, list(a.positive_scores))
        index.search(np.asarray(a.q, np.int64), keeper)
        for j, (pid, ps) in enumerate(zip(a.positive_ids, a.positive_scores)):
            out += [(a.vec_id, a.key, pid, ps, int(index.ids[r]), int(s)) for r, s in zip(keeper.rows[j], keeper.scores[j])]
    return pd.DataFrame(out, columns=["anchor_id", "anchor_key", "positive_id", "positive_score", "negative_id", "negative_score"])


def _blocks(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int):
    """Every row once for each anchor block, every anchor once for each shard."""
    rows = rows.withColumn("shard", F.pmod(F.col("key"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # both sides come from one table
    anchors = anchors.withColumn("block", F.pmod(F.col("key"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return rows.groupBy("shard", "block"), anchors.groupBy("shard", "block")


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows taking part whose vec_id is divisible by 100; identical rows (same
    vec_id, label and vector) act as one anchor and as one row "other" than it.  An anchor
    without other rows of its label, and a positive whose range holds no row of another
    label, give no rows.  A positive with a negative score has an empty range; one with
    score 0 takes rows of score 0.  Ties go to the smaller vec_id.  No rows give no rows.
    """
    spark = embeddings.sparkSession
    rows = stored(prepared(embeddings), "negatives-rows")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % ANCHOR_EVERY == 0, 1)).alias("a")).first()
    shards, blocks = max(1, -(-counts.n // SHARD_ROWS)), max(1, -(-counts.a // BLOCK_ANCHORS))
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).dropDuplicates(["vec_id", "key"])

    r, a = _blocks(rows, anchors, shards, blocks)
    found = r.cogroup(a).applyInPandas(lambda x, y: _positives(x, y), POSITIVE_ROWS)
    order = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.col("positive_score").desc(), F.col("positive_id"))
    positives = stored(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= POSITIVES).drop("n"), "negatives-positives")

    first = F.struct((-F.col("positive_score")).alias("s"), F.col("positive_id").alias("i"))
    lists = positives.groupBy("anchor_id", "anchor_key").agg(F.sort_array(F.collect_list(first)).alias("p"))  # POSITIVES at most
    lists = lists.select(
        F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"),
        F.col("p.i").alias("positive_ids"), F.transform("p", lambda x: -x.getField("s")).alias("positive_scores"),
    )
    with_lists = anchors.join(lists, ["vec_id", "key"])
    r, a = _blocks(rows, with_lists, shards, blocks)
    found = r.cogroup(a).applyInPandas(lambda x, y: _negatives(x, y), NEGATIVE_ROWS)
    order = Window.partitionBy("anchor_id", "anchor_key", "positive_id").orderBy(F.col("negative_score").desc(), F.col("negative_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
