"""Near-dedup links every two texts of a bucket that are close, however large the bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from rankweave.llm import near_dedup


def twins(n: int) -> list[str]:
    """Texts in twos that are nearly equal; all share a part too small to be near copies for."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(10**6)}"
    common = [word() for _ in range(300)]
    out = []
    for _ in range(n):
        own = common + [word() for _ in range(100)]
        out += [" ".join(own), " ".join([*own[:350], word(), *own[351:]])]
    return out


def test_no_link_of_a_large_bucket_is_lost(spark, tmp_path):
    texts = twins(40)
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    s = near_dedup.Settings(sketches=4, minima=1, all_pairs=2, neighbours=0, levels=1)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.read.parquet(path), s=s).collect()}
    keys = [near_dedup.labelled(g) for _, g in near_dedup.shingles(pa.array(texts), s.words)]
    close = {(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.aligned(keys[i], keys[j], s.similarity)}
    assert close == {(i + 1, i) for i in range(0, len(texts), 2)}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_a_refused_pair_has_no_alignment():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.concatenate([base[: 400 - cut], rng.integers(0, 1 << 62, more).astype(np.uint64)])
            for cut in range(0, 120, 6) for more in (0, 5, 40, 90)]
    n, bins = np.array([len(k) for k in sets]), np.stack([near_dedup.histogram(k) for k in sets])
    refused = 0
    for x, one in enumerate(sets):
        fits = near_dedup.may_link(n[x], bins[x], n, bins, 0.8)
        refused += int((~fits).sum())
        for y in np.flatnonzero(~fits):
            assert near_dedup.aligned(one, sets[y], 0.8) == 0.0
        assert fits[x]
    assert refused


def test_dedup_keeps_one_of_every_two(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(twins(40))), "doc_id bigint, text string").write.parquet(path)
    s = near_dedup.Settings(sketches=4, minima=1, all_pairs=2, neighbours=0, levels=1)
    kept = near_dedup.dedup_near(spark.read.parquet(path), s=s)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))


def test_the_pairs_of_all_levels_are_made_at_once(spark, tmp_path, monkeypatch):
    kept, written = near_dedup.stored, []
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: written.append(name) or kept(df, name))
    path = str(tmp_path / "nodes")
    rows = [(bytes([i]), i, [i % 3, i % 2, i, 7]) for i in range(30)]
    spark.createDataFrame(rows, "node binary, uid long, sketches array<long>").write.parquet(path)
    nodes = spark.read.parquet(path)
    pairs = {}
    for levels in (1, 2):
        s = near_dedup.Settings(sketches=4, minima=1, all_pairs=2, levels=levels)
        written.clear()
        found, _ = near_dedup.candidates(nodes, s)
        assert written.count("near-neighbours") == 1 and written.count("near-buckets") == levels
        pairs[levels] = {(bytes(r.a), bytes(r.b)) for r in found.collect()}
    assert pairs[1] < pairs[2] and all(a < b for a, b in pairs[2])
