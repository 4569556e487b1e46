"""Suffix-array dedup: remove every long byte string that also starts earlier.

The suffix array is sparse.  Of each window of ``length`` bytes one anchor is chosen, the
leftmost ``ANCHOR``-byte gram of smallest hash, so equal windows anchor at the same place
and only suffixes at anchors, about one in 37 bytes, need sorting.  An anchor stands for the
region of all windows that chose it.

1. Suffixes are led by two tokens, the name of their anchor gram and that of their region.
   Sampled splitters range-partition them by (tokens, document, position), so one hot token
   spreads over several buckets; buckets are sorted, and equal neighbours are regions that
   occur again.  What stands at a bucket's edge is decided once the neighbours' edges are known.
2. Regions that share a gram with another region but aren't equal to it hold the ends of
   repeats.  Their bytes are sorted window by window, 8-byte token after token, by multikey
   quicksort.  A gram with very many such regions is split by hashes of whole windows.
3. Each text gets the verdicts on its regions and windows back and drops the covered bytes.

Texts are shuffled once, by document; everything else that moves is a few numbers a region.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh, key_of, portions, stored
from .kernels import BYTE_VALUES, BYTES, U64, Roller, byte_values, mix, per_row, runs, slices

LENGTH = 100
ANCHOR = 24
# Slices that stay in the processor's cache.
SLICE = 1 << 17
# Regions sharing a gram that one task sorts (their windows take about 300 MB); beyond, windows are dealt out.
HOT_REGIONS = 1 << 16
# Windows sorted at once.
SORT_WINDOWS = 50_000
# For splitters: documents looked at per bucket, and suffixes taken of one.
SAMPLE_DOCS, SAMPLE_SUFFIXES = 40, 16

_POSITION = (1 << 24) - 1
_ROW = U64(0x9E3779B97F4A7C15)
_SECOND = Roller(0xA0761D6478BD642F)
_SECOND_VALUES = byte_values(77)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n, low, span = len(values) - width + 1, values, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[width - span : width - span + n])


class Regions:
    """The anchors of the texts in a slice, in text order, and the regions they stand for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        self.data, self.offsets = data, offsets
        self.prefix = BYTES.prefix(BYTE_VALUES[data])
        none = np.zeros(0, np.int64)
        self.row = self.at = self.first = self.last = none
        self.gram = self.name = none
        if len(data) < length:
            return
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        whole = np.flatnonzero(owner[: len(data) - length + 1] == owner[length - 1 :])
        if not len(whole):
            return
        grams = BYTES.windows(self.prefix, anchor)
        if len(grams) <= _POSITION:
            # The position in the low bits makes the leftmost of equal grams the smallest.
            marked = (grams & ~U64(_POSITION)) | np.arange(len(grams), dtype=U64)
            chosen = (sliding_min(marked, length - anchor + 1) & U64(_POSITION)).astype(np.int64)[whole]
        else:
            chosen = _chosen_in_parts(grams, length - anchor + 1)[whole]
        new = np.ones(len(whole), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (owner[whole[1:]] != owner[whole[:-1]])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(whole)) - 1
        self.first, self.last, self.at = whole[start], whole[stop] + length, chosen[start]
        self.row = owner[self.first]
        self.gram = grams[self.at].view(np.int64)
        shape = (self.at - self.first) * (4 * length) + (self.last - self.first)
        self.name = (BYTES.spans(self.prefix, self.first, self.last) ^ mix(shape.astype(U64))).view(np.int64)

    def first_in_text(self) -> np.ndarray:
        """Indexes of regions that haven't occurred before in their own text."""
        keys = mix(self.name.view(U64) + self.row.astype(U64) * _ROW)
        _, index = np.unique(keys, return_index=True)
        return np.sort(index)

    def named(self, rows: np.ndarray, names: np.ndarray) -> np.ndarray:
        """For each region, the index of (its text, its name) among the given pairs, or -1."""
        keys = mix(names.view(U64) + rows.astype(U64) * _ROW)
        order = np.argsort(keys)
        own = mix(self.name.view(U64) + self.row.astype(U64) * _ROW)
        place = np.searchsorted(keys[order], own)
        place[place == len(keys)] = 0
        return np.where(keys[order][place] == own, order[place], -1) if len(keys) else np.full(len(own), -1)


def _chosen_in_parts(grams: np.ndarray, width: int) -> np.ndarray:
    """Anchors of a text too long for the positions packed beside the hashes."""
    step = _POSITION - width
    parts = []
    for at in range(0, len(grams) - width + 1, step):
        part = grams[at : at + step + width - 1]
        marked = (part & ~U64(_POSITION)) | np.arange(len(part), dtype=U64)
        parts.append((sliding_min(marked, width) & U64(_POSITION)).astype(np.int64) + at)
    return np.concatenate(parts)


def multikey_order(n: int, tokens: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the first token, then, only among equals, by the next; and the run of each.

    Equal strings have the same run, which is the place of the first of them.
    """
    order = np.arange(n)
    run = np.zeros(n, np.int64)
    open_at = np.arange(n)  # places in ``order`` whose string isn't unique so far
    for token in tokens:
        if not len(open_at):
            break
        values, group = token[order[open_at]], run[open_at]
        by = np.lexsort((values, group))
        order[open_at] = order[open_at][by]
        values = values[by]
        new = np.ones(len(by), bool)
        new[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
        run[open_at] = open_at[np.flatnonzero(new)][np.cumsum(new) - 1]
        single = new & np.append(new[1:], True)
        open_at = open_at[~single]
    return order, run


def _suffix_rows(length: int, anchor: int, splitters: list[np.ndarray] | None, take: int = 0):
    """Suffix rows of each text; with ``take`` only that many of each, evenly spaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            keys = batch.column("k").to_numpy()
            out: list[list[np.ndarray]] = [[], [], [], []]
            for low, _, data, offsets in slices(batch.column("text"), SLICE):
                found = Regions(data, offsets, length, anchor)
                use = found.first_in_text()
                if take and len(use):
                    use = use[np.linspace(0, len(use) - 1, min(take * (len(offsets) - 1), len(use))).astype(int)]
                row = found.row[use]
                columns = (found.gram[use], found.name[use], keys[low + row], found.at[use] - offsets[row])
                for part, column in zip(out, columns, strict=True):
                    part.append(column)
            gram, name, key, at = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in out)
            arrays = [pa.array(c, pa.int64()) for c in (gram, name, key)] + [pa.array(at.astype(np.int32))]
            names = ["h", "r", "k", "p"]
            if splitters is not None:
                arrays.append(pa.array(bucket_of([gram, name, key], splitters).astype(np.int32)))
                names.append("bucket")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def bucket_of(columns: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters are smaller than each row, column by column."""
    low = np.searchsorted(splitters[0], columns[0], "left")
    high = np.searchsorted(splitters[0], columns[0], "right")
    bucket = low.copy()
    tied = np.flatnonzero(low < high)
    for step in range(int((high - low)[tied].max()) if len(tied) else 0):
        rows = tied[low[tied] + step < high[tied]]
        at = low[rows] + step
        second, third = splitters[1][at], splitters[2][at]
        bucket[rows] += (second < columns[1][rows]) | (second == columns[1][rows]) & (third < columns[2][rows])
    return bucket


def _splitters(texts: DataFrame, length: int, anchor: int, buckets: int, rows: int) -> list[np.ndarray]:
    """Bucket bounds from a sample whose size depends on the number of buckets alone."""
    share = min(1.0, buckets * SAMPLE_DOCS / max(1, rows))
    sample = texts.sample(False, share, 7).mapInArrow(
        _suffix_rows(length, anchor, None, SAMPLE_SUFFIXES), "h long, r long, k long, p int"
    )
    found = sample.select("h", "r", "k").toArrow()
    columns = [found.column(c).to_numpy() for c in ("h", "r", "k")]
    order = np.lexsort(columns[::-1])
    at = np.linspace(0, len(order), buckets + 1)[1:-1].astype(int)
    at = np.unique(at[at < len(order)])
    return [c[order[at]] for c in columns]


EQUAL, DIFFERS, EDGE, BOUNDS = range(4)
_SCANNED = "kind int, h long, r long, k long, bucket int, flags int, h2 long, r2 long, k2 long"
_FIRST_ROW, _IN_FIRST, _IN_LAST, _SHARED = 1, 2, 4, 8


def _scan(hot: int):
    """Compare neighbours of one sorted bucket.

    EQUAL: the region also starts earlier.  DIFFERS: other regions have its gram (flags: how
    many, if hot).  EDGE: a distinct region of the bucket's first or last gram.  BOUNDS: the
    bucket's first and last suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        bucket = context.partitionId() if context else 0
        held: list[np.ndarray] | None = None
        bounds: list[int] | None = None

        def rows(kind: int, at: np.ndarray, columns: list[np.ndarray], flags) -> list[np.ndarray]:
            n = len(at)
            return [np.full(n, kind), *(c[at] for c in columns), np.full(n, bucket), np.broadcast_to(flags, n)]

        def decide(columns: list[np.ndarray], first: bool, last: bool) -> pa.RecordBatch:
            h, r, k = columns
            n = len(h)
            new_h = np.ones(n, bool)
            new_h[1:] = h[1:] != h[:-1]
            new_r = new_h.copy()
            new_r[1:] |= r[1:] != r[:-1]
            group = np.cumsum(new_h) - 1
            distinct = np.bincount(group, new_r)[group]
            head = np.maximum.accumulate(np.where(new_r, np.arange(n), 0))
            in_first = (group == 0) & first
            in_last = (group == group[-1]) & last
            again = np.flatnonzero(~new_r & (k != k[head]))
            edge = np.flatnonzero(new_r & (in_first | in_last))
            shared = np.flatnonzero(new_r & (distinct > 1) & ~in_first & ~in_last)
            flags = in_first * _IN_FIRST + in_last * _IN_LAST + (distinct > 1) * _SHARED
            if first:
                flags[0] += _FIRST_ROW
            parts = [
                rows(EQUAL, again, columns, 0),
                rows(DIFFERS, shared, columns, (distinct[shared] > hot).astype(int)),
                rows(EDGE, edge, columns, flags[edge]),
            ]
            return _scanned([np.concatenate(c) for c in zip(*parts, strict=True)])

        first = True
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("h", "r", "k")]
            if not len(columns[0]):
                continue
            if bounds is None:
                bounds = [int(c[0]) for c in columns]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [c[cut:] for c in columns]
            if cut:
                yield decide([c[:cut] for c in columns], first, False)
                first = False
        if held is not None and bounds is not None:
            yield decide(held, first, True)
            yield _scanned(
                [np.array([v]) for v in (BOUNDS, *bounds, bucket, 0)], [np.array([int(c[-1])]) for c in held]
            )

    return run


def _scanned(columns: list[np.ndarray], more: list[np.ndarray] | None = None) -> pa.RecordBatch:
    n = len(columns[0])
    more = more or [np.zeros(n, np.int64)] * 3
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()] + [pa.int64()] * 3
    arrays = [pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip([*columns, *more], kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _SCANNED.split(", ")])


def _across(spark: SparkSession, scanned: DataFrame, hot: int) -> DataFrame:
    """EDGE rows with what stands next to their bucket: one row of bounds per bucket is read."""
    bounds = sorted(scanned.where(F.col("kind") == BOUNDS).collect(), key=lambda b: b.bucket)
    near = []
    for i, b in enumerate(bounds):
        before = bounds[i - 1] if i else None
        after = bounds[i + 1] if i + 1 < len(bounds) else None
        near.append(
            (b.bucket, before and before.h2, before and before.r2, before and before.k2, after and after.h)
        )
    near_by = spark.createDataFrame(near, "bucket int, before_h long, before_r long, before_k long, after_h long")
    edges = scanned.where(F.col("kind") == EDGE).join(F.broadcast(near_by), "bucket", "left")

    def has(flag: int):
        return F.col("flags").bitwiseAND(flag) != 0

    goes_on = has(_FIRST_ROW) & F.col("h").eqNullSafe(F.col("before_h")) & F.col("r").eqNullSafe(F.col("before_r"))
    again = goes_on & (F.col("k") != F.col("before_k"))
    shared = has(_SHARED) | has(_IN_FIRST) & F.col("h").eqNullSafe(F.col("before_h")) | has(_IN_LAST) & F.col("h").eqNullSafe(F.col("after_h"))
    kind = F.when(again, EQUAL).when(shared, DIFFERS)
    # A gram that goes over an edge is known by its EDGE rows alone.  Few can be hot: two per bucket.
    hot_grams = edges.groupBy("h").count().where(F.col("count") > hot).select("h", F.lit(1).alias("hot"))
    found = edges.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return found.join(F.broadcast(hot_grams), "h", "left").select("kind", "h", "r", "k", F.coalesce("hot", F.lit(0)).alias("flags"))


def _asked(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows and fields of a list-of-struct column, flattened."""
    column = batch.column(name)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(lengths)), lengths), [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]


def _contents(text: str, key: str, asked: str, length: int, anchor: int, hot: bool):
    """Bytes of the regions asked for; of hot ones two hashes of each window instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            keys = batch.column(key).to_numpy()
            rows, (names, grams, heat) = _asked(batch, asked)
            use = (heat > 0) == hot
            rows, names, grams = rows[use], names[use], grams[use]
            for low, high, data, offsets in slices(batch.column(text), SLICE):
                mine = slice(*np.searchsorted(rows, (low, high)))
                if mine.start == mine.stop:
                    continue
                found = Regions(data, offsets, length, anchor)
                use = found.first_in_text()
                use = use[found.named(rows[mine] - low, names[mine])[use] >= 0]
                row, first, last = found.row[use], found.first[use], found.last[use]
                if hot:
                    n = last - first - length + 1
                    which = np.repeat(np.arange(len(use)), n)
                    start = first[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    second = _SECOND.prefix(_SECOND_VALUES[data])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(BYTES.spans(found.prefix, start, start + length).view(np.int64)),
                            pa.array(_SECOND.spans(second, start, start + length).view(np.int64)),
                            pa.array(keys[low + row[which]]),
                            pa.array((start - offsets[row[which]]).astype(np.int64)),
                        ],
                        names=["w1", "w2", "k", "s"],
                    )
                else:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.gram[use]),
                            pa.array(keys[low + row]),
                            pa.array((first - offsets[row]).astype(np.int64)),
                            pa.array([data[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
                        ],
                        names=["h", "k", "s", "bytes"],
                    )

    return run


def _compare(length: int):
    """Sort the windows of regions that share a gram; later ones of equal windows become spans."""

    def windows(keys: np.ndarray, starts: np.ndarray, contents: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(c) for c in contents], np.int64)
        data = np.frombuffer(b"".join(contents) + bytes(8), np.uint8).astype(U64)
        token = np.zeros(len(data) - 7, U64)
        for i in range(8):
            token = (token << U64(8)) | data[i : i + len(token)]
        n = sizes - length + 1
        which = np.repeat(np.arange(len(n)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(sizes) - sizes)[which] + inner
        places = [*range(0, length - 7, 8), length - 8]
        order, run = multikey_order(len(at), (token[at + p] for p in places))
        key, start = keys[which], starts[which] + inner
        # Of each run of equal windows the earliest stays.
        sort = np.lexsort((start[order], key[order], run))
        order, run = order[sort], run[sort]
        head = np.ones(len(run), bool)
        head[1:] = run[1:] != run[:-1]
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(run)), 0))]
        late = order[(key[order] != key[first]) | (start[order] != start[first])]
        late = np.sort(late)
        new = np.ones(len(late), bool)
        new[1:] = (late[1:] != late[:-1] + 1) | (which[late[1:]] != which[late[:-1]])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(late)) - 1
        arrays = [key[late[head]], start[late[head]], start[late[tail]] + length] if len(late) else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["k", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            h = held.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
            yield from pieces(held.slice(0, cut))
            held = held.slice(cut)
        if held is not None:
            yield from pieces(held)

    def pieces(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole groups of equal grams, so many at once that their windows fit."""
        if not rows.num_rows:
            return
        h, k, s = (rows.column(c).to_numpy() for c in ("h", "k", "s"))
        contents = rows.column("bytes").to_pylist()
        total = np.cumsum([len(c) - length + 1 for c in contents])
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        at = 0
        while at < len(h):
            limit = (total[at - 1] if at else 0) + SORT_WINDOWS
            fit = ends[(ends > at) & (total[ends - 1] <= limit)]
            end = int(fit[-1]) if len(fit) else int(ends[ends > at][0])
            yield windows(k[at:end], s[at:end], contents[at:end])
            at = end

    return run


def _rebuild(text: str, edits: str, length: int, anchor: int, extra: dict[str, str]):
    """Drop the covered bytes; ``extra`` names the columns added for counts and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, text):
            rows, (a, b) = _asked(batch, edits)
            kept: list[bytes] = []
            counts: list[list[np.ndarray]] = [[], [], []]
            for low, high, data, offsets in slices(batch.column(text), SLICE):
                mine = slice(*np.searchsorted(rows, (low, high)))
                row, begin, end = rows[mine] - low, a[mine], b[mine]
                found = Regions(data, offsets, length, anchor)
                gone = np.ones(len(found.row), bool)
                gone[found.first_in_text()] = False
                whole = end < 0
                gone |= found.named(row[whole], begin[whole]) >= 0
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, found.first[gone], 1)
                np.add.at(step, found.last[gone], -1)
                np.add.at(step, begin[~whole] + offsets[row[~whole]], 1)
                np.add.at(step, end[~whole] + offsets[row[~whole]], -1)
                removed = np.cumsum(step[:-1]) > 0
                left, bounds = data[~removed].tobytes(), np.append(0, np.cumsum(per_row(~removed, offsets)))
                kept.extend(left[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True))
                spans, _ = runs(removed, offsets)
                for part, values in zip(
                    counts, (np.diff(offsets), per_row(removed, offsets), np.diff(np.searchsorted(spans, offsets))), strict=True
                ):
                    part.append(values)
            n_bytes, n_removed, n_spans = (np.concatenate(c).astype(np.int64) for c in counts)
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != edits}
            if extra:
                for name, values in (("n_bytes", n_bytes), ("n_removed", n_removed), ("n_spans", n_spans)):
                    columns[extra[name]] = pa.array(values)
                columns[extra["kept"]] = pa.array(kept, pa.binary())
            else:
                # A cut may leave part of a character; that part goes too.
                null = np.array([not v.is_valid for v in columns[text]])
                changed = [None if z else t.decode(errors="ignore") for t, z in zip(kept, null, strict=True)]
                columns[text] = pa.array(changed, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def dedup_suffixes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR,
    hot: int = HOT_REGIONS, report: bool = False,
) -> DataFrame:
    """``docs`` without the bytes covered by a ``length``-byte string that also starts earlier.

    Earlier is a smaller id, or the same document and an earlier start.  Strings are those
    of the input, so a removal doesn't save another's first occurrence.  With ``report`` the
    text stays and ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``
    (the bytes that remain) are added; otherwise the text is replaced, and parts of characters
    at a cut go too.  A null text is empty and stays null; a text shorter than ``length`` is
    left alone; all rows with a null id are one document, before every other, and so are rows
    that repeat an id: they don't remove each other's bytes.  Other columns pass through,
    whatever their names; a table without rows gives none.
    """
    if not 8 <= anchor <= length:
        raise ValueError("an anchor needs 8 bytes, and at most as many as the string")
    spark = docs.sparkSession
    key, asked = fresh(docs, "_key"), fresh(docs, "_asked")
    keyed = docs.withColumn(key, key_of(doc_id))
    texts = keyed.select(F.col(key).alias("k"), F.col(text).alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _splitters(texts, length, anchor, buckets, docs.count())
    suffixes = texts.mapInArrow(_suffix_rows(length, anchor, bounds), "h long, r long, k long, p int, bucket int")
    sorted_buckets = suffixes.repartitionById(buckets, F.col("bucket")).select("h", "r", "k", "p").sortWithinPartitions("h", "r", "k", "p")
    scanned = stored(sorted_buckets.mapInArrow(_scan(hot), _SCANNED), "suffix-neighbours")

    decided = scanned.where(F.col("kind").isin(EQUAL, DIFFERS)).select("kind", "h", "r", "k", "flags").unionByName(_across(spark, scanned, hot))
    wanted = (
        decided.where(F.col("kind") == DIFFERS)
        .groupBy(F.col("k").alias(key))
        .agg(F.collect_list(F.struct("r", "h", "flags")).alias(asked))
    )
    parts = keyed.join(wanted.hint("shuffle_hash"), key)
    contents = parts.mapInArrow(_contents(text, key, asked, length, anchor, False), "h long, k long, s long, bytes binary")
    compared = contents.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(length), "k long, a long, b long")
    windows = parts.mapInArrow(_contents(text, key, asked, length, anchor, True), "w1 long, w2 long, k long, s long")
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct("k", "s")).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = windows.join(earliest, ["w1", "w2"]).where(F.struct("k", "s") != F.col("first"))
    edits = (
        decided.where(F.col("kind") == EQUAL).select("k", F.col("r").alias("a"), F.lit(-1).cast("long").alias("b"))
        .unionByName(compared)
        .unionByName(late.select("k", F.col("s").alias("a"), (F.col("s") + length).alias("b")))
    )
    per_text = edits.groupBy(F.col("k").alias(key)).agg(F.collect_list(F.struct("a", "b")).alias(asked))
    joined = keyed.join(per_text.hint("shuffle_hash"), key, "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], asked)
    fields, extra = list(docs.schema.fields), {}
    if report:
        for name, kind in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType())):
            extra[name] = fresh(docs, name)
            fields.append(T.StructField(extra[name], kind))
    return joined.mapInArrow(_rebuild(text, asked, length, anchor, extra), T.StructType(fields))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_suffixes(docs, report=True).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
