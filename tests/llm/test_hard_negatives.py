"""Hard negatives: brute force by the contract, awkward rows, and pruning that stays exact."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from rankweave.llm import hard_negatives as H
from rankweave.session import ship_package

from . import data


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_query_matches_brute_force_on_whole_tables(spark):
    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select vec_id, embedding, label from '{folder}/embeddings.parquet'").fetchall()
    found = entry.queries()["op13_hard_negatives"](spark, folder)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(data.hard_negatives(rows))


def awkward(n=3000, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        scale = rnd.choice([0.05, 0.3, 1.0])
        rows.append((i, [rnd.gauss(0, scale) for _ in range(8)], rnd.randrange(3)))
    rows += [(4200, None, 1), (4300, [0.1] * 8, None), (4400, [0.1, None] + [0.0] * 6, 1), (4500, [math.nan] + [0.1] * 7, 2),
             (4600, [math.inf] + [0.1] * 7, 2), (None, [0.2] * 8, 1), (4700, [0.0] * 8, 0), (4800, [0.0] * 8, 1),
             (4900, [-0.5] * 8, 0), (5000, [0.5] * 8, 0), (5000, [0.5] * 8, 0), (5100, [0.5] * 8, 0), (5200, [0.001] * 8, 2)]
    rows += [(6000 + i, [0.5] * 8, 1) for i in range(12)]  # ties
    return rows


def test_awkward_rows(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    found = sorted(tuple(r) for r in H.mine(df).collect())
    want = sorted(data.hard_negatives([(i, None if e is None else [float(np.float32(x)) if x is not None else None for x in e], lab) for i, e, lab in rows]))
    assert found == want and len(found) > 100


def test_several_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD_ROWS", 700)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", 7)
    rows = awkward(2500, seed=5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = sorted(tuple(r) for r in H.mine(df).collect())
    want = sorted(data.hard_negatives([(i, None if e is None else [float(np.float32(x)) if x is not None else None for x in e], lab) for i, e, lab in rows]))
    assert found == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert H.mine(df).count() == 0


def test_pruning_verifies_fewer_rows_and_stays_exact():
    rng = np.random.default_rng(1)
    vecs = np.floor(256 * rng.normal(0, 0.2, (20_000, 32)) * rng.choice([0.2, 1, 3], (20_000, 1))).astype(np.int64)
    ids, labels = np.arange(20_000), rng.integers(0, 10, 20_000)
    index = H.Index(ids, labels, ids * 0, vecs)
    offered = []
    for a in range(0, 20_000, 500):
        keeper = H.Positives(index, labels[a], a, 0)
        seen = keeper.offer
        keeper.offer = lambda r, s, seen=seen: (offered.append(len(r)), seen(r, s))
        index.search(vecs[a], keeper)
        scores = vecs @ vecs[a]
        mask = (labels == labels[a]) & (ids != a)
        best = np.lexsort((ids[mask], -scores[mask]))[:5]
        assert list(index.ids[keeper.rows]) == list(ids[mask][best])
    assert sum(offered) < 0.5 * 40 * 20_000
