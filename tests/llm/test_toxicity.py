"""The toxicity factorization machine."""

from __future__ import annotations

import random
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rankweave.llm import toxicity
from rankweave.session import ship_package

from . import data


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_query_scores_every_document(spark):
    scored = entry.queries()["op11_toxicity"](spark, "/root/testdata/sf0.01")
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert scored.count() == 1000 and scored.where("score < 0 or score > 1 or score is null").count() == 0
    assert scored.where("predicted != cast(score >= 0.5 as int)").count() == 0


def test_held_out_accuracy_beats_the_constant_answer(spark):
    scored = entry.queries()["op11_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = scored.join(labels, "doc_id").where("held_out").toPandas()
    constant = 1 - held.toxic.mean()
    assert len(held) > 500 and (held.predicted == held.toxic).mean() > constant + 0.03
    assert (held[held.predicted == 1].toxic == 1).mean() > 0.9


def pairs_corpus(n=1200, seed=4):
    """Toxic only where an insult and a group are both there; each alone is clean."""
    rnd = random.Random(seed)
    filler = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        words = rnd.sample(filler, 12) + (["idiots"] if insult else []) + (["villagers"] if group else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_a_pair_of_terms_is_learned(spark):
    rows = pairs_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(found[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(s >= 0.5) == y for s, y in held])
    assert right > 0.9  # a linear model can't tell "both" from "either" this well


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = pairs_corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, turned))
    assert (a.weights == b.weights).all() and a.bias == b.bias


@pytest.mark.parametrize("values", [[], [1], [0]])
def test_model_without_two_classes(spark, values):
    docs = data.frame(spark, data.awkward_texts(), repeat_ids=True)
    labels = spark.createDataFrame([(i, v) for v in values for i in range(20)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scored) == docs.count()
    if values:
        assert all((r.score >= 0.5) == (values == [1]) for r in scored)
    else:  # no label at all: an even chance
        assert all(r.score == 0.5 for r in scored)


def test_awkward_rows_score_by_text_alone(spark):
    """Nulls, empty and long texts, repeated ids and clashing columns; ``score`` is replaced."""
    texts = data.awkward_texts() + ["idiot " * 200_000]
    docs = data.frame(spark, texts, repeat_ids=True).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*[c for c in docs.columns if c != "score"], "score"]
    one = {}
    for r in scored.collect():
        assert 0 <= r.score <= 1 and one.setdefault(r.text or "", r.score) == r.score
    empty = 1 / (1 + np.exp(-model.bias))
    assert one[""] == pytest.approx(empty)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_term_sets_are_bounded():
    s = replace(toxicity.Settings(), buckets=64)
    assert len(toxicity.terms(" ".join(f"w{i}" for i in range(10_000)), s)) <= 64
    assert len(toxicity.terms(None, s)) == 0 and len(toxicity.terms("", s)) == 0
