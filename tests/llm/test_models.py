"""The quality classifier, near-dedup and the pipeline."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rankweave.llm import near_dedup, quality_model
from rankweave.llm.queries import ORACLES
from rankweave.session import ship_package

from ..conftest import SF_DIR
from ..test_oracles import rows as sorted_rows
from . import data


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_held_out_documents_are_told_apart(spark):
    scored = entry.queries()["op1_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert scored.count() == 1000 and scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} words {i}") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(quality_model.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_model.fit(docs, x) for x in (labels, turned))
    assert (a.vectors == b.vectors).all() and (a.bias == b.bias).all()


@pytest.mark.parametrize("values", [[], [1], [0]])
def test_model_without_two_classes(spark, values):
    docs = data.frame(spark, data.awkward_texts(), repeat_ids=True)
    labels = spark.createDataFrame([(i, v) for v in values for i in range(20)], "doc_id long, quality int")
    scored = quality_model.score(docs, quality_model.fit(docs, labels)).collect()
    assert len(scored) == docs.count()
    assert all((r.score >= 0.5) == (values != [0]) for r in scored)


def test_scores_depend_on_the_text_alone(spark):
    docs = data.frame(spark, data.awkward_texts(), repeat_ids=True)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    scored = quality_model.score(docs, model)
    assert scored.columns == [*docs.columns, "score"]
    one = {}
    for r in scored.collect():
        assert one.setdefault(r.text or "", r.score) == r.score
    assert quality_model.score(docs.limit(0), model).count() == 0


def edited(words, rnd, edits):
    out = list(words)
    for _ in range(edits):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10**6)}"
    return out


def families(seed=3):
    """Texts around a few originals, many around one of them, some only like another copy."""
    rnd = random.Random(seed)
    texts = []
    for n in (1, 2, 3, 5, 40):
        base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
        texts += [" ".join(edited(base, rnd, rnd.randrange(0, 5))) for _ in range(n)]
        far = edited(base, rnd, 6)
        texts += [" ".join(far), " ".join(edited(far, rnd, 2)), " ".join(far).upper() + "!"]
    return texts + ["w1 w2", "w1, W2", "w1 w3", "one two three four", ""] + [None]


def brute_classes(texts, s):
    keys = [near_dedup.labelled(g) for _, g in near_dedup.shingles(pa.array(texts), s.words)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(keys[a]) and near_dedup.aligned(keys[a], keys[b], s.similarity) >= s.similarity:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in range(len(texts))}


def test_near_classes(spark, tmp_path):
    texts = families()
    got = near_dedup.near_classes(data.table(spark, tmp_path / "t", texts)).collect()
    want = brute_classes(texts, near_dedup.Settings())
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = np.bincount(list(want.values()), minlength=len(texts))
    assert all(r.class_size == sizes[r.class_id] for r in got)


def test_near_dedup_keeps_one_row_of_each_class(spark, tmp_path):
    texts = families()
    docs = data.table(spark, tmp_path / "t", texts)
    kept = near_dedup.dedup_near(docs)
    want = set(brute_classes(texts, near_dedup.Settings()).values())
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_near_dedup_of_odd_tables(spark, tmp_path):
    docs = data.table(spark, tmp_path / "t", data.awkward_texts(), repeat_ids=True)
    rows = near_dedup.near_classes(docs).collect()
    assert len(rows) == docs.count()
    # The row without an id leads the class of the text it shares with document 0.
    assert [r.class_id for r in rows if r.doc_id == 0] == [None]
    assert near_dedup.near_classes(docs.limit(0)).count() == 0
    assert near_dedup.dedup_near(docs.limit(0)).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    rnd = random.Random(8)
    for _ in range(300):
        a = rnd.sample(range(60), rnd.randint(1, 40))
        b = list(a)
        for _ in range(rnd.randint(0, 6)):
            i = rnd.randrange(len(b))
            rnd.choice([lambda: b.insert(i, rnd.randint(100, 10**6)), lambda: len(b) > 1 and b.pop(i), lambda: b.append(b.pop(i))])()
        b = list(dict.fromkeys(b))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        share = table[-1, -1] / (len(a) + len(b) - table[-1, -1])
        got = near_dedup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert got == (pytest.approx(share) if share >= 0.8 else 0.0)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(60)] + [(b"a", b"b")], "a binary, b binary")
    labels = {bytes(r.node): bytes(r.label) for r in near_dedup.components(links).collect()}
    assert set(labels.values()) == {b"000", b"a"} and len(labels) == 63


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted_rows(got.columns, map(tuple, got.collect())) == sorted_rows(columns, want.fetchall())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    table = data.table(spark, tmp_path / "t", data.awkward_texts() + [r.text for r in docs.limit(40).collect()], repeat_ids=True)
    for source in (table, table.limit(0)):
        rows = source
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF_DIR)
            assert out.columns == source.columns, name
            rows = near_dedup.stored(out, "test-stage")
            assert rows.count() <= source.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF_DIR).where("start = 0").count() == rows.count()


def test_pipeline_is_its_stages(spark):
    from rankweave.llm import line_dedup, packing, suffix_dedup

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = quality_model.keep_good(docs, labels).select("doc_id", "text").collect()
    lines = data.line_dedup([(r.doc_id, r.text) for r in good])
    left = [(i, t[2]) for i, t in sorted(lines.items())]
    classes = brute_classes([t for _, t in left], near_dedup.Settings())
    first = [left[i] for i in sorted(set(classes.values()))]
    ends = {i: w[3].decode(errors="ignore") for i, w in data.suffix_dedup(first, suffix_dedup.LENGTH).items()}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in got} == set(ends)
    want = packing.pieces(spark.createDataFrame(list(ends.items()), "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.doc_tokens) for r in got} == {(r.doc_id, r.doc_tokens) for r in want}
    assert sum(r.length for r in got) == sum(r.length for r in want) and line_dedup
