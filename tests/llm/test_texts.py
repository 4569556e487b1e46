"""Line, suffix and exact dedup, rules and licenses against brute force, with awkward tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import exact_dedup, license_scan, line_dedup, quality_rules, suffix_dedup
from rankweave.session import ship_package

from . import data


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_line_dedup(spark):
    texts = data.awkward_texts()
    got = line_dedup.dedup_lines(data.frame(spark, texts), report=True).collect()
    want = data.line_dedup(enumerate_list(texts))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == want
    assert line_dedup.dedup_lines(data.frame(spark, texts)).columns == data.frame(spark, texts).columns


def test_line_dedup_of_repeated_and_missing_ids(spark):
    texts = data.awkward_texts()
    docs = data.frame(spark, texts, repeat_ids=True)
    got = line_dedup.dedup_lines(docs, report=True)
    assert got.count() == docs.count()
    # The row without an id is the first document, so the other holder of its lines loses them.
    kept = {r.doc_id: r.n_dropped for r in got.where("doc_id is null or doc_id = 0").collect()}
    assert kept[None] == 0 and kept[0] == sum(len(x.strip()) >= 10 for x in texts[0].split("\n"))


def enumerate_list(texts):
    return list(enumerate(texts))


@pytest.mark.parametrize(("length", "anchor", "hot"), [(20, 8, 1 << 16), (30, 12, 2), (100, 24, 1 << 16)])
def test_suffix_dedup(spark, length, anchor, hot):
    texts = data.awkward_texts(length)
    got = suffix_dedup.dedup_suffixes(data.frame(spark, texts), length=length, anchor=anchor, hot=hot, report=True).collect()
    want = data.suffix_dedup(enumerate_list(texts), length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_suffix_dedup_keeps_rows_and_columns(spark):
    docs = data.frame(spark, data.awkward_texts(), repeat_ids=True)
    out = suffix_dedup.dedup_suffixes(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()


def test_one_gram_over_many_buckets(spark):
    """A third of all suffixes are led by the same tokens, so every bucket border lies inside them."""
    texts = ["the same opening words of every text " + str(i) + " and its end" for i in range(150)] + ["the same opening words of every text 7 and its end"] * 80
    got = suffix_dedup.dedup_suffixes(data.frame(spark, texts), length=30, anchor=12, report=True).collect()
    want = data.suffix_dedup(enumerate_list(texts), 30)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_multikey_order():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 3, 500, dtype=np.uint64) for _ in range(4)]
    order, run = suffix_dedup.multikey_order(500, columns)
    rows = list(zip(*(c.tolist() for c in columns), strict=True))
    assert [rows[i] for i in order] == sorted(rows)
    assert all((rows[order[i]] == rows[order[i + 1]]) == (run[i] == run[i + 1]) for i in range(499))


def test_anchors_of_a_long_text_agree_with_those_of_its_parts(monkeypatch):
    data_ = np.random.default_rng(2).integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 5000])
    whole = suffix_dedup.Regions(data_, offsets, 60, 16)
    monkeypatch.setattr(suffix_dedup, "_POSITION", (1 << 10) - 1)
    parts = suffix_dedup.Regions(data_, offsets, 60, 16)
    # Fewer hash bits decide here, so anchors may differ, but windows are all covered.
    for found in (whole, parts):
        covered = np.zeros(5000, bool)
        for a, b in zip(found.first, found.last, strict=True):
            covered[a:b] = True
        assert covered.all() and (found.at >= found.first).all()


@pytest.fixture
def files(spark, tmp_path):
    texts = data.awkward_texts()
    half = len(texts) // 2
    rows = enumerate_list(texts)
    for name, part in (("a", rows[:half]), ("b", rows[half:])):
        spark.createDataFrame(part, "doc_id long, text string").withColumn("extra", F.lit(None).cast("int")).repartition(3).write.parquet(str(tmp_path / name))
    return tmp_path, rows


def test_exact_dedup(spark, files):
    home, rows = files
    whole = str(home / "whole")
    spark.read.parquet(str(home / "a"), str(home / "b")).repartition(4).write.parquet(whole)
    got = exact_dedup.dedup_files(spark, whole, files_per_batch=1)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == data.exact_dedup(rows)


def test_exact_dedup_goes_on_where_it_was(spark, files, tmp_path):
    home, rows = files
    source, state = str(home / "grows"), str(tmp_path / "kept-state")
    spark.read.parquet(str(home / "a")).write.parquet(source)
    exact_dedup.dedup_files(spark, source, home=state).collect()
    spark.read.parquet(str(home / "b")).write.mode("append").parquet(source)
    got = exact_dedup.dedup_files(spark, source, home=state)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == data.exact_dedup(rows)


def test_exact_dedup_keeps_one_row_of_a_repeated_id(spark, tmp_path):
    source = str(tmp_path / "repeated")
    spark.createDataFrame([(1, "a b"), (1, "ab"), (1, "ab "), (None, "a  b"), (None, None)], "doc_id long, text string").write.parquet(source)
    rows = exact_dedup.dedup_files(spark, source).collect()
    assert len(rows) == 5 and sum(r.kept for r in rows) == 2
    assert all(r.keep_id is None for r in rows)  # the longest of the equal texts has no id


def test_a_hit_with_other_bytes_is_an_error(spark, monkeypatch):
    rows = spark.createDataFrame([(bytearray(b"\1" * 32), 2)], "digest binary, n long")
    bits = exact_dedup._hit_bits(rows)
    at = int.from_bytes(b"\1\1\1", "big")
    assert bits.sum() == 1 << (at & 7) and bits[at >> 3]


def test_quality_measures(spark):
    texts = data.awkward_texts() + ["a b c d e " * 30, "# $ % | <x>\n# $ % | <x>\n# $ % | <x>"]
    got = quality_rules.judged(data.frame(spark, texts, repeat_ids=False)).collect()
    for r in got:
        want = data.base_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept) and 0 <= r.posterior <= 1


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    right = rng.random((20_000, 5)) < accuracy
    votes = np.where(truth[:, None] == right, 1, -1) * (rng.random((20_000, 5)) < 0.9)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(model.accuracy() - accuracy).max() < 0.04


@pytest.mark.parametrize("patterns", [np.zeros((0, 3), int), np.ones((1, 3), int)])
def test_em_of_next_to_nothing(patterns):
    model = quality_rules.fit(patterns, np.ones(len(patterns)))
    assert np.isfinite(model.weights()).all() and 0 < model.prior < 1


def test_license_places(spark):
    texts = [
        "Apache License, apache\nLICENSE and the GNU General Public License; mit-license CC BY", "cc by cc by", None, "", "apache",
        "Permission is hereby granted, totally free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0", "émit license", "x " * 5000 + "mit license",
    ] + data.awkward_texts()
    rows = {r.doc_id: r for r in license_scan.licenses(data.frame(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        words = data.license_words(text)
        found = data.phrases_at(words, license_scan.PHRASES)
        starts = [s for s, _ in found]
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(words), len(found), min(starts, default=None), max(starts, default=None),
        )
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[5].labels == "mit-text" and rows[6].labels == "apache,apache-2.0"
    assert rows[7].labels == "cc-by,cc-by-nc-4.0"


def test_license_notices_with_one_change(spark):
    cases = []
    for label, wordings in license_scan.NOTICES.items():
        words = (wordings if isinstance(wordings, str) else wordings[0]).split()
        core = license_scan.core_pairs(" ".join(words), license_scan.CORES.get(label, ()))
        fixed = core | {i + 1 for i in core}
        cases += [(label, [*words[:i], "really", *words[i:]]) for i in range(1, len(words)) if i - 1 not in core]
        cases += [(label, [*words[:i], "other", *words[i + 1 :]]) for i in range(len(words)) if i not in fixed and (label, i) != ("mit-notice", 1)]
    others = {
        "Licensed under the terms of the Apache License, Version 2.0": "apache,apache-2.0",
        "Use it as the GNU General Public License, version 3, says": "gpl,gpl-3.0", "GPL v3": "gpl-3.0",
        "Licensed under CC BY 4.0": "cc-by,cc-by-4.0", "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
        "Licensed under CC BY-ND 4.0": "cc-by", "Licensed under CC BY-NC 3.0": "cc-by",
        "licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
        "licensed under the GNU General Public License": "gpl", "licensed under the GNU Lesser General Public License, version 3": "",
        # A pair doesn't show a first word that stands alone: this isn't told from any "the MIT license".
        "released other the MIT license": "mit", "about the MIT license": "mit",
        "Licensed under the Apache License, Version 1.1": "apache", "released under the BSD license": "",
    }
    texts = ["so it is " + " ".join(words) + " as said" for _, words in cases] + [*others]
    rows = {r.doc_id: r.labels for r in license_scan.licenses(data.frame(spark, texts)).collect()}
    names = set(license_scan.NOTICES)
    assert [(texts[i], rows[i]) for i, (label, _) in enumerate(cases) if set(rows[i].split(",")) & names != {label}] == []
    assert {t: rows[len(cases) + i] for i, t in enumerate(others)} == others


def test_empty_tables(spark):
    none = data.frame(spark, []).limit(0)
    assert line_dedup.dedup_lines(none).count() == 0
    assert suffix_dedup.dedup_suffixes(none).count() == 0
    assert quality_rules.judged(none).count() == 0
    assert license_scan.licenses(none).count() == 0


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    docs = data.frame(spark, data.awkward_texts(), repeat_ids=True)
    assert quality_rules.judged(docs).count() == docs.count()
    assert license_scan.licenses(docs).count() == docs.count()


def test_kept_bytes_have_the_digest_of_the_query(spark):
    texts = ["é" * 120, "é" * 120]
    rows = suffix_dedup.dedup_suffixes(data.frame(spark, texts), report=True).select("doc_id", F.sha2("kept", 256).alias("s")).collect()
    want = data.suffix_dedup(enumerate_list(texts), 100)
    assert {r.doc_id: r.s for r in rows} == {i: hashlib.sha256(w[3]).hexdigest() for i, w in want.items()}
