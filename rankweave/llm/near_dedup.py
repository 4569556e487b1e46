"""Near-dedup with Order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often it has
occurred before.  A sketch takes, under one hash function, the few smallest labelled
shingles and keeps them in text order, so two sketches agree only if the texts share those
shingles in that order.  Texts with an equal sketch are candidates; two texts are linked if
an alignment of their shingle sequences matches enough: matched / (all - matched).

Texts of equal words are one node before anything else happens, so exact copies never meet
in a bucket.  A bucket of few nodes compares them all; in a larger one every node is first
compared with the node that most buckets have in common and with its neighbours in an order of
the sketches, a number of pairs in proportion to the bucket.  Then all other pairs of a larger
bucket that these links have not brought into one class are looked at, tile by tile: numbers of
shingles and histograms of them rule out pairs that no alignment can link, and the rest are
aligned.  Classes are the connected components of the links, the same as if every pair of
every bucket had been aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, documents, empty_if_null, fresh, key_of, portions, stored
from .kernels import BYTE_VALUES, BYTES, IS_ALNUM, TO_LOWER, U64, WORDS, Roller, mix, runs, slices

_SECOND = Roller(0xE7037ED1A0B428DB)
# Bins of a text's shingle histogram, and nodes of a large bucket that are compared at once.
BINS = 1024
TILE = 512


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    # Sketches of a text, and labelled shingles in each.
    sketches: int = 20
    minima: int = 4
    # Buckets up to this size compare all their nodes.
    all_pairs: int = 8
    # Neighbours a node of a larger bucket is compared with, besides the most common node.
    neighbours: int = 2
    # How often a larger bucket is split by further sketches, and by how many each time.
    levels: int = 2
    splits: int = 5
    seed: int = 5


def shingles(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text the hashes of its words, and of its shingles in order.

    A text of fewer words than a shingle has one shingle, all its words; one without words none.
    """
    for _, _, data, offsets in slices(column):
        data = TO_LOWER[data]
        starts, ends = runs(IS_ALNUM[data], offsets)
        bounds = np.searchsorted(starts, offsets)
        words = BYTES.spans(BYTES.prefix(BYTE_VALUES[data]), starts, ends) ^ mix((ends - starts).astype(U64))
        prefix = WORDS.prefix(words)
        grams = WORDS.windows(prefix, width)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if high - low >= width:
                yield words[low:high], grams[low : high - width + 1]
            elif high > low:
                yield words[low:high], WORDS.spans(prefix, np.array([low]), np.array([high])) ^ U64(high - low)
            else:
                yield words[:0], grams[:0]


def labelled(grams: np.ndarray) -> np.ndarray:
    """Keys that tell apart the first, second, ... occurrence of a shingle."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return grams
    at = np.arange(len(grams))
    count = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(grams)
    out[order] = np.where(count > 0, mix(ranked + count.astype(U64) * U64(0x9E3779B97F4A7C15)), ranked)
    return out


def order_sketches(keys: np.ndarray, seeds: np.ndarray, minima: int) -> np.ndarray:
    """One value per seed: its smallest ``minima`` keys, in text order."""
    out = np.empty(len(seeds), U64)
    step = max(1, (1 << 20) // max(1, len(keys)))
    for at in range(0, len(seeds), step):
        part = seeds[at : at + step]
        hashed = mix(keys[None, :] ^ part[:, None])
        if len(keys) > minima:
            places = np.sort(np.argpartition(hashed, minima - 1, axis=1)[:, :minima], axis=1)
        else:
            places = np.broadcast_to(np.arange(len(keys)), (len(part), len(keys)))
        value = mix(part.copy())
        for column in places.T:
            value = mix(value * U64(0x9FB21C651E98DF25) + keys[column])
        out[at : at + step] = value
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Matched share of two shingle sequences, or 0 if it can't reach ``least``.

    Matches are looked for within the band that a similarity of ``least`` allows; labelled
    shingles occur once, so the best alignment is the longest rising run of places in ``b``.
    """
    total = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    need = least * total / (1 + least)
    order = np.argsort(b)
    place = np.searchsorted(b[order], a)
    place[place == len(b)] = 0
    at = order[place]
    band = total - 2 * need + 1
    hit = (b[at] == a) & (np.abs(at - np.arange(len(a))) <= band)
    at = at[hit]
    if len(at) < need - 1e-9:
        return 0.0
    matched = len(at)
    if matched > 1 and not (at[1:] > at[:-1]).all():
        tails: list[int] = []
        for x in at.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        matched = len(tails)
    found = matched / (total - matched)
    return found if found >= least - 1e-12 else 0.0


def _seeds(s: Settings) -> np.ndarray:
    return np.random.default_rng(s.seed).integers(0, 1 << 63, s.sketches, dtype=U64)


def _node(words: np.ndarray) -> bytes | None:
    """The name of all texts of these words."""
    if not len(words):
        return None
    whole = np.array([0]), np.array([len(words)])
    parts = [WORDS.spans(WORDS.prefix(words), *whole), _SECOND.spans(_SECOND.prefix(words), *whole) ^ U64(len(words))]
    return np.concatenate(parts).tobytes()


def histogram(keys: np.ndarray) -> np.ndarray:
    """How many keys fall into each bin; counts over 255 are 255, which makes differences smaller only."""
    counts = np.bincount((mix(keys) >> U64(54)).astype(np.int64), minlength=BINS)
    return np.minimum(counts, 255).astype(np.uint8)


def may_link(n: int, bins: np.ndarray, ns: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Which of the others an alignment could still link to a text of ``n`` shingles.

    Shingles that lie in a bin of one text and not in the other's match nothing, so matched is
    at most half of what is left; a pair that is refused here gets 0 from ``aligned``.
    """
    total = ns + n
    fits = np.minimum(ns, n) >= least * np.maximum(ns, n)
    fits[fits] = np.abs(others[fits].astype(np.int16) - bins.astype(np.int16)).sum(axis=1) <= (
        total[fits] - 2 * (least * total[fits] / (1 + least) - 1e-9)
    )
    return fits


def _nodes(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(s)
        for batch in portions(batches):
            nodes, sketches = [], []
            for words, grams in shingles(batch.column("text"), s.words):
                nodes.append(_node(words))
                sketches.append(order_sketches(labelled(grams), seeds, s.minima).view(np.int64) if len(words) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("k"), pa.array(nodes, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["uid", "k", "node", "sketches"],
            )

    return run


def _histograms(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            keys = [labelled(grams) for _, grams in shingles(batch.column("text"), s.words)]
            bins = pa.array([histogram(k).tobytes() for k in keys], pa.binary())
            sizes = pa.array([len(k) for k in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sizes, bins], names=["node", "n", "bins"])

    return run


def _across(s: Settings):
    """Pairs of two tiles whose classes differ and which an alignment could link."""

    def pairs(group: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
        nodes = group.column("node").to_pylist()
        label = group.column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        n = group.column("n").to_numpy()
        bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), np.uint8).reshape(len(nodes), BINS)
        tile, i, j = group.column("tile").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        a, b = [], []
        for x in left:
            others = right[right > x] if i == j else right
            others = others[label[others] != label[x]]
            for y in others[may_link(n[x], bins[x], n[others], bins[others], s.similarity)]:
                one, two = nodes[x], nodes[y]
                a.append(min(one, two))
                b.append(max(one, two))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            at = 0
            for end in ends.tolist():
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in pairs(rows.slice(at, end - at))], names=["a", "b"])
                at = end
            held = rows.slice(at)
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in pairs(held)], names=["a", "b"])

    return run


def _align(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(portions(batches, "text_a"), "text_b"):
            sides = []
            for side in "ab":
                names = batch.column(side).to_pylist()
                read = zip(names, shingles(batch.column(f"text_{side}"), s.words), strict=True)
                sides.append(labelled(grams) if _node(words) == name else None for name, (words, grams) in read)
            found = []
            for a, b in zip(*sides, strict=True):
                if a is None or b is None:
                    raise ValueError("rows have other numbers than when they were sketched; give a table read from files")
                found.append(aligned(a, b, s.similarity))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
            )

    return run


def candidates(nodes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes to align first, a < b, from a table of (node, sketches), and the
    (bucket, node, size) of the buckets whose other pairs are left to ``rest_of``.

    A bucket too large to compare all is also split by a second sketch (and with more levels
    what is still large by a third); texts close to each other, though not to the bucket's
    most common node, meet in a small part of it.
    """
    def at(place: Column) -> Column:
        return F.get("sketches", F.pmod(place, F.lit(s.sketches)).cast("int"))

    # Beside each node two more of its sketches, so that neighbours by these agree on more than the bucket's.
    following = [at(F.col("last") + i).alias(f"next{i}") for i in (1, 2)]
    places = F.explode(F.sequence(F.lit(0), F.lit(s.sketches - 1))).alias("last")
    rows = nodes.select("node", "sketches", places)
    rows = rows.select("node", "last", F.xxhash64("last", at(F.col("last"))).alias("bucket"), *following)
    levels = None
    for level in range(s.levels):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        ranked = stored(rows.join(sizes, "bucket"), "near-buckets")
        if levels is None:
            # How much company a node has over all its buckets: texts that others derive from come first.
            company = ranked.groupBy("node").agg(F.sum("size").alias("company"))
            ranked = stored(ranked.join(company, "node"), "near-ranked")
            first = ranked.where(F.col("size") > s.all_pairs).select("bucket", "node", "size")
        levels = ranked if levels is None else levels.unionByName(ranked)
        if level + 1 < s.levels:
            large = ranked.where(F.col("size") > s.all_pairs).select("node", "company", "last", "bucket")
            step = F.explode(F.sequence(F.lit(1), F.lit(s.splits))).alias("step")
            split = large.join(nodes.select("node", "sketches"), "node").select("*", step)
            split = split.withColumn("last", F.pmod(F.col("last") + F.col("step"), F.lit(s.sketches)))
            key = F.xxhash64("bucket", "last", at(F.col("last"))).alias("bucket")
            rows = split.select("node", "company", "last", key, *following)
    # The buckets of all levels at once: a shuffle for each level costs the driver more than the tasks.
    return _pairs_of(levels, s).distinct(), first


def rest_of(large: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame, done: DataFrame, s: Settings) -> DataFrame:
    """Every other pair of the large buckets that could join two classes.

    Two nodes of one class need no link, so only buckets with nodes of several classes are
    left.  They are cut into tiles, and each two tiles are compared by a task's step of their
    own, whose size does not follow from the bucket's; only pairs that may link become rows.
    """
    named = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    rows = named.join(mixed.select("bucket"), "bucket", "left_semi").withColumns(
        {"tile": F.pmod(F.xxhash64("node"), tiles).cast("int"), "tiles": tiles}
    )
    rows = stored(rows.select("bucket", "node", "label", "tile", "tiles"), "near-mixed")
    members = stored(rows.select("node").distinct().join(nodes.select("node", "uid"), "node"), "near-members")
    bins = texts.join(members, "uid").select("node", "text").mapInArrow(_histograms(s), "node binary, n long, bins binary")
    rows = rows.join(bins, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "label", "n", "bins"
    )
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(_across(s), "a binary, b binary").distinct().join(done, ["a", "b"], "left_anti")


def _pairs_of(ranked: DataFrame, s: Settings) -> DataFrame:
    """All pairs of small buckets, and of large ones those that bring most of a class together."""
    small = ranked.where(F.col("size") <= s.all_pairs)
    groups = small.groupBy("bucket").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    pairs = groups.select(F.explode(F.expr(
        "flatten(transform(nodes, (x, i) -> transform(slice(nodes, i + 2, size(nodes)), y -> struct(x AS a, y AS b))))"
    )).alias("p")).select("p.*")

    large = ranked.where(F.col("size") > s.all_pairs)
    rank = F.struct("company", F.xxhash64("node"), "node")
    heads = large.groupBy("bucket").agg(F.max_by("node", rank).alias("other"))
    ends = large.join(heads, "bucket").select("node", "other")
    # Neighbours by further sketches, within slices of a bucket so that no task sorts a whole hot one.
    slice_of = F.when(F.col("size") > 4096, F.pmod(F.xxhash64("next1"), F.ceil(F.col("size") / 2048))).otherwise(F.lit(0))
    order = Window.partitionBy("bucket", "slice").orderBy("next1", "next2", rank)
    leads = [F.lead("node", i).over(order).alias(f"lead{i}") for i in range(1, s.neighbours + 1)]
    near = stored(large.withColumn("slice", slice_of).select("node", *leads), "near-neighbours")
    for lead in near.columns[1:]:
        ends = ends.unionByName(near.select("node", F.col(lead).alias("other")))
    ends = ends.where(F.col("other").isNotNull() & (F.col("node") != F.col("other")))
    return pairs.unionByName(ends.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for nodes with a link.

    Every node takes its smallest neighbour for a parent, parents are followed to their ends,
    and what is left are the links between different ends, usually few after the first round.
    Every step is a written table, so nothing is computed twice and no lineage grows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.distinct(), "near-links")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while True:
        parents = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        parents = stored(parents, "near-parents")
        while True:
            higher = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(parents.join(higher, "up").select("node", "up", "top"), "near-parents")
            moved = jumped.where(F.col("up") != F.col("top")).limit(1).count()
            parents = jumped.select("node", F.col("top").alias("up"))
            if not moved:
                break
        ends = parents.withColumnRenamed("node", "label")
        labels = stored(labels.join(ends, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "near-labels")
        a_ends = parents.withColumnsRenamed({"node": "a", "up": "a_end"})
        b_ends = parents.withColumnsRenamed({"node": "b", "up": "b_end"})
        left = edges.join(a_ends, "a").join(b_ends, "b").where(F.col("a_end") != F.col("b_end"))
        edges = stored(left.select(F.col("a_end").alias("a"), F.col("b_end").alias("b")).distinct(), "near-links")
        if not edges.limit(1).count():
            return labels


def classified(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """Rows (uid, k, class): the near-duplicate class of every row of ``docs``.

    ``uid`` numbers the rows as they are read, ``k`` is the id (null as the smallest number), and
    ``class`` names the class; it is null for a text without words, which is no duplicate of
    anything.  Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in
    lower case.  Rows of equal words share a class, also if an id repeats.  ``docs`` has to be a
    table read from files, as its rows are numbered more than once; other numbers are an error.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), key_of(doc_id).alias("k"), empty_if_null(text).alias("text"))
    seen = stored(rows.mapInArrow(_nodes(s), "uid long, k long, node binary, sketches array<long>"), "near-nodes")
    firsts = seen.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("uid").alias("uid"), F.first("sketches").alias("sketches"))
    firsts = stored(firsts, "near-distinct")
    pairs, large = candidates(firsts, s)
    pairs = stored(pairs, "near-pairs")
    texts = rows.select("uid", "text")
    labels = components(_linked(pairs, firsts, texts, s))
    rest = stored(rest_of(large, firsts, texts, labels, pairs, s), "near-rest")
    found = seen.select("uid", "k", "node").join(labels, "node", "left").select("uid", "k", F.coalesce("label", "node").alias("class"))
    if not rest.limit(1).count():
        return found
    # Links of the rest join whole classes.
    links = _linked(rest, firsts, texts, s)
    for side in "ab":
        links = links.join(labels.withColumnsRenamed({"node": side, "label": f"of_{side}"}), side, "left")
    joined = links.select(*[F.coalesce(f"of_{side}", side).alias(side) for side in "ab"])
    tops = components(joined.where("a != b")).withColumnsRenamed({"node": "class", "label": "top"})
    return found.join(tops, "class", "left").select("uid", "k", F.coalesce("top", "class").alias("class"))


def _linked(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose texts are similar enough, aligned and written."""
    # Both text joins use one exchange of the texts.
    where = firsts.select("node", "uid")
    ends = pairs.join(where.withColumnsRenamed({"node": "a", "uid": "uid_a"}), "a").join(
        where.withColumnsRenamed({"node": "b", "uid": "uid_b"}), "b"
    )
    half = ends.join(texts.withColumnsRenamed({"uid": "uid_b", "text": "text_b"}), "uid_b").select("a", "b", "uid_a", "text_b")
    whole = half.join(texts.withColumnsRenamed({"uid": "uid_a", "text": "text_a"}), "uid_a").select("a", "b", "text_a", "text_b")
    links = whole.mapInArrow(_align(s), "a binary, b binary, similarity double").where(F.col("similarity") >= s.similarity)
    return stored(links, "near-verified")


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest id of the class), ``class_size``.

    A text without words, null or empty, is a class of its own.  Rows that repeat an id are
    documents of their own; a null id is smaller than all others, and the class it leads has a
    null ``class_id``.  A table without rows gives none; other columns are not read.
    """
    found = classified(docs, text, doc_id, s)
    sizes = found.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("k").alias("least"), F.count("*").alias("n"))
    joined = found.join(sizes, "class", "left")
    return joined.select(
        F.nullif("k", F.lit(NO_ID)).alias("doc_id"),
        F.nullif(F.coalesce("least", "k"), F.lit(NO_ID)).alias("class_id"),
        F.coalesce("n", F.lit(1)).alias("class_size"),
    )


def dedup_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, that of the smallest id (then first read).

    Texts without words all stay.  Columns are those of ``docs``, whatever their names.
    """
    found = classified(docs, text, doc_id, s)
    best = found.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.struct("k", "uid")).alias("best"))
    stay = best.select("best.uid").unionByName(found.where(F.col("class").isNull()).select("uid"))
    uid = fresh(docs, "_uid")
    numbered = docs.withColumn(uid, F.monotonically_increasing_id())
    return numbered.join(stay.withColumnRenamed("uid", uid), uid, "left_semi").drop(uid)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir).select("doc_id", "text"))
