"""Importance resampling: brute force by the contract, pieces, and the intern table."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from rankweave.llm import resampling
from rankweave.session import ship_package

from . import data

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def same(found, expected):
    got = found.toPandas()[COLUMNS].sort_values(COLUMNS, na_position="last").reset_index(drop=True)
    want = pd.DataFrame(expected, columns=COLUMNS).sort_values(COLUMNS, na_position="last").reset_index(drop=True)
    for c in COLUMNS:
        assert (got[c].fillna(-1).astype("int64") == want[c].fillna(-1).astype("int64")).all(), c


def test_query_matches_brute_force_on_whole_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    target = [r[0] for r in duckdb.sql(f"select text from '{folder}/benchmark.parquet'").fetchall()]
    found = entry.queries()["op12_importance_resampling"](spark, folder)
    assert found.count() == len(docs)
    same(found, data.importance_resampling(docs, target))


def test_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows, null ids, clashing columns, ties."""
    texts = data.awkward_texts() + ["Zeta ÄÖ 12ab " * 30_000, "tie " * 25, "tie " * 25]
    docs = data.table(spark, tmp_path / "docs", texts, repeat_ids=True).withColumn("weight", resampling.F.lit("clash"))
    target = spark.createDataFrame([("tie tie tie abcd",), (None,), ("",)], "text string")
    gain = resampling.gains(resampling.bucket_counts(docs), resampling.bucket_counts(target))
    scored = resampling.weigh(docs, gain).withColumn("score", (resampling.F.col("weight") + resampling.noise("doc_id")).cast("long"))
    out = resampling.ranked(scored.drop("text").withColumn("eligible", resampling.F.col("n_words") >= 20), "eligible",
                            [resampling.F.col("score").desc(), resampling.F.col("doc_id").asc_nulls_last(), resampling.F.col("n_features").asc()])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(out, data.importance_resampling(rows, ["tie tie tie abcd", None, ""]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.bucket_counts(docs).sum() == 0
    scored = resampling.weigh(docs, np.zeros(resampling.BUCKETS, np.int64)).withColumn("score", resampling.F.col("weight"))
    assert resampling.ranked(scored.withColumn("e", resampling.F.lit(True)), "e", ["score"]).count() == 0


def test_pieces_keep_ngrams_whole(monkeypatch):
    texts = [" ".join(f"w{i % 7}" for i in range(50)), None, "a b", " ".join(f"xé{i}" for i in range(33))]
    whole = [list(resampling.features(*p)) for p in resampling.pieces(texts)]
    monkeypatch.setattr(resampling, "PIECE_WORDS", 4)
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 3)
    cut = [list(resampling.features(*p)) for p in resampling.pieces(texts)]

    def per_row(parts):
        out = {}
        for piece in parts:
            for rows, buckets in piece:
                for r, b in zip(rows.tolist(), buckets.tolist()):
                    out.setdefault(r, []).append(b)
        return {r: sorted(v) for r, v in out.items()}

    assert per_row(whole) == per_row(cut)
    assert sum(len(v) for v in per_row(cut).values()) == (50 + 49 + 48) + (2 + 1) + (33 + 32 + 31)


def test_joined_crcs_equal_crcs_of_joined_bytes():
    import random
    import zlib

    rnd = random.Random(1)
    for _ in range(300):
        a, b = (bytes(rnd.randrange(256) for _ in range(rnd.randrange(0, n))) for n in (40, 5000))
        joined = resampling.crc_join(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert joined[0] == zlib.crc32(a + b" " + b)


def test_table_verifies_values_on_equal_keys():
    values = np.array(["a", "b", "a", "c", "b", "a"], dtype=object)
    keys = np.zeros(len(values), np.uint64)  # every key collides
    slots = resampling.Table(len(values)).intern(keys, lambda a, b: values[a] == values[b])
    assert len(set(slots.tolist())) == 3
    assert slots[0] == slots[2] == slots[5] and slots[1] == slots[4] and slots[3] not in (slots[0], slots[1])
