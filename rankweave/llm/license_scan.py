"""License scan by diagonal voting.

Every word pair of every text is joined to the places it has in known notices.  A match at
text position i and template position j votes for the diagonal i - j; a notice that stands
in the text word by word fills one diagonal, a notice with words added or left out fills a
few neighbouring ones, and pairs that match by chance scatter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, empty_if_null, per_batch
from .kernels import BYTE_VALUES, BYTES, IS_ALNUM, TO_LOWER, U64, WORDS, Roller, byte_values, mix, runs, slices

# Phrases that must be found word by word, with their labels.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
# Wordings of well-known notices; these may differ by a few words.
NOTICES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met",
    "cc-by-4.0": ("licensed under cc by 4 0", "cc by 4 0"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa 4 0"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl v2", "gpl version 2"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl v3", "gpl version 3"),
    "mit-notice": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
    "associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
# Names and versions in them that tell one license from another, and may not differ.
CORES = {
    "apache-2.0": ("apache license", "2 0"),
    "cc-by-4.0": ("cc by 4 0",),
    "cc-by-nc-4.0": ("cc by nc 4 0",),
    "cc-by-sa-4.0": ("cc by sa 4 0",),
    "gpl-2.0": ("gnu general public license", "version 2"),
    "gpl-3.0": ("gnu general public license", "version 3"),
    "mit-notice": ("mit license",),
    "mpl-2.0": ("mozilla public license", "2 0"),
}

GRAM = 2
# Diagonals this close are one notice, at this density.
NEAR = 3
STRETCH = 1.5
# A notice of fewer words has to stand as it is; others may have one error, and one in so many words.
SHORT, ERROR_WORDS = 5, 6

_SECOND_VALUES = byte_values(51)
_SECOND_BYTES, _SECOND_WORDS = Roller(0xA24BAED4963EE407), Roller(0x9FB21C651E98DF25)
# A pair that every text has once, at position -1, so that texts without a match stay.
_PRESENT = 1
_ROWS = "row long, doc_id long, grams array<struct<g: long, v: long>>"


def word_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each word and its successor, and the bounds of each text's words.

    The last pair of a text reaches into the next text; callers leave it out.
    """
    data = TO_LOWER[data]
    starts, ends = runs(IS_ALNUM[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    out = []
    for values, bytes_, words in ((BYTE_VALUES, BYTES, WORDS), (_SECOND_VALUES, _SECOND_BYTES, _SECOND_WORDS)):
        hashes = bytes_.spans(bytes_.prefix(values[data]), starts, ends) ^ mix((ends - starts).astype(U64))
        out.append(words.windows(words.prefix(hashes), GRAM).view(np.int64))
    return out[0], out[1], bounds


def _pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
    first, second, sizes = [], [], []
    for _, _, data, offsets in slices(batch.column("text")):
        g, v, bounds = word_pairs(data, offsets)
        n = np.diff(bounds)
        pairs = np.maximum(n - GRAM + 1, 0)
        # Place 0 of a text says how many words it has, the pairs follow.
        size = pairs + 1
        begin = np.cumsum(size) - size
        own_g, own_v = np.full(size.sum(), _PRESENT, np.int64), np.empty(size.sum(), np.int64)
        own_v[begin] = n
        inside = np.ones(len(own_g), bool)
        inside[begin] = False
        source = np.repeat(bounds[:-1] - (begin + 1), size) + np.arange(len(own_g))
        own_g[inside], own_v[inside] = g[source[inside]], v[source[inside]]
        first.append(own_g)
        second.append(own_v)
        sizes.append(size)
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], names=["g", "v"])
    ends = np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int32)
    grams = pa.ListArray.from_arrays(pa.array(ends), flat)
    return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), grams], names=["row", "doc_id", "grams"])


def core_pairs(words: str, cores: tuple[str, ...]) -> set[int]:
    """Places of the pairs of ``words`` that lie inside one of ``cores``."""
    have, out = words.split(), set()
    for core in cores:
        want = core.split()
        for at in range(len(have) - len(want) + 1):
            if have[at : at + len(want)] == want:
                out.update(range(at, at + len(want) - GRAM + 1))
    return out


def errors_allowed(n_words: int) -> int:
    return 0 if n_words < SHORT else max(1, n_words // ERROR_WORDS)


def templates(
    spark: SparkSession, phrases: dict[str, str], notices: dict[str, str | tuple[str, ...]], cores: dict[str, tuple[str, ...]]
) -> DataFrame:
    """Every pair of every template: as many rows as the templates have words, fixed by the caller."""
    rows = [(0, "", False, 0, 0, 0, False, -1, _PRESENT, 0)]
    every = [(label, True, words) for label, words in phrases.items()]
    every += [(label, False, w) for label, words in notices.items() for w in ((words,) if isinstance(words, str) else words)]
    for number, (label, exact, words) in enumerate(every, 1):
        data = np.frombuffer(words.encode(), np.uint8)
        g, v, bounds = word_pairs(data, np.array([0, len(data)]))
        n = int(bounds[1]) - GRAM + 1
        if n < 1:
            raise ValueError(f"a template needs {GRAM} words: {words!r}")
        core = set() if exact else core_pairs(words, cores.get(label, ()))
        allowed = 0 if exact else errors_allowed(n + GRAM - 1)
        rows += [(number, label, exact, n, allowed, len(core), j in core, j, int(g[j]), int(v[j])) for j in range(n)]
    return spark.createDataFrame(
        rows, "template int, label string, exact boolean, pairs int, allowed int, cores int, core boolean, at int, g long, check long"
    )


def scan(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
    phrases: dict[str, str] = PHRASES, notices: dict[str, str | tuple[str, ...]] = NOTICES,
    cores: dict[str, tuple[str, ...]] = CORES,
) -> DataFrame:
    """Confirmed spans: (row, doc_id, label, exact, start, words, coverage), and a row of label "" per text.

    ``words`` of the row with label "" is the number of words of the text.  Words are runs
    of ASCII letters and digits and of all non-ASCII characters, A-Z in lower case.  A pair
    counts as matched only if both of its hashes agree.  Phrases have to fill their diagonal.
    Notices may have as many errors as ``errors_allowed`` says, within ``STRETCH`` times their
    length: a place with words added counts one, a word replaced or left out one; the pairs in
    ``cores`` must all be there.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), empty_if_null(text).alias("text")
    )
    pairs = rows.mapInArrow(per_batch(_pairs), _ROWS).select("row", "doc_id", F.posexplode("grams").alias("pos", "gram"))
    known = templates(docs.sparkSession, phrases, notices, cores)
    matched = pairs.join(F.broadcast(known), F.col("gram.g") == F.col("g")).where(
        (F.col("label") == "") | (F.col("gram.v") == F.col("check"))
    )
    # Place 0 isn't a pair, so pair i is at place i + 1.
    at = F.col("pos") - 1
    votes = matched.groupBy(
        "row", "doc_id", "template", "label", "exact", "pairs", "allowed", "cores", (at - F.col("at")).alias("diagonal")
    ).agg(
        F.collect_set("at").alias("hits"),
        F.collect_set(F.when(F.col("core"), F.col("at"))).alias("core_hits"),
        F.min(at).alias("low"),
        F.max(at).alias("high"),
        F.max(F.when(F.col("label") == "", F.col("gram.v"))).alias("words"),
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(NEAR + 1)) > NEAR)
    group = F.sum(F.when(apart, 1).otherwise(0)).over(order)
    merged = (
        votes.withColumn("group", group)
        .groupBy("row", "doc_id", "template", "label", "exact", "pairs", "allowed", "cores", "group")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("found"),
            F.size(F.array_distinct(F.flatten(F.collect_list("core_hits")))).alias("core_hits"),
            F.min("low").alias("start"),
            (F.max("high") - F.min("low") + GRAM).alias("span"),
            F.max("words").alias("words"),
        )
    )
    merged = merged.withColumn("hits", F.size("found")).withColumn(
        "errors",
        # One missing pair is an addition, more are one word fewer, left out or replaced.  At an end of a
        # short notice they count as so many words: what is left doesn't show whether its first word stands.
        F.expr(
            "aggregate(transform(found, (x, i) -> if(i = 0, 0, greatest(x - found[i - 1] - 2, int(x - found[i - 1] > 1)))), 0, (a, x) -> a + x)"
            " + aggregate(array(found[0], pairs - 1 - found[size(found) - 1]), 0,"
            " (a, x) -> a + if(pairs > 4 * allowed, greatest(x - 1, int(x > 0)), x))"
        ),
    )
    share = F.when(F.col("label") == "", F.lit(0.0)).otherwise(F.col("hits") / F.col("pairs"))
    fits = (F.col("errors") <= F.col("allowed")) & (F.col("core_hits") == F.col("cores")) & (F.col("span") <= STRETCH * (F.col("pairs") + GRAM - 1))
    confirmed = (F.col("label") == "") | F.when(F.col("exact"), F.col("hits") == F.col("pairs")).otherwise(fits)
    return merged.where(confirmed).select(
        "row", "doc_id", "label", "exact", "start", F.coalesce("words", F.col("span").cast("long")).alias("words"), share.alias("coverage")
    )


def licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: where phrases stand, which labels it has, and how sure that is.

    ``score`` is the largest share of a confirmed template.  A null or empty text has no words,
    no labels, null places and score 0; rows that repeat an id or have none are documents of
    their own; a table without rows gives none; other columns are not read.
    """
    found = scan(docs, text, doc_id, **options)
    named = F.col("label") != ""
    base = F.col("exact") & named

    def labels(which):
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.max(F.when(~named, F.col("words"))).alias("n_words"),
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
            labels(base).alias("base_labels"),
            labels(named).alias("labels"),
            F.max("coverage").alias("score"),
        )
        .drop("row")
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return licenses(documents(spark, sf_dir))
