"""The stored model registry and the searcher that finds its model by name."""

from __future__ import annotations

import pytest

from rankweave.operators.searchers import VectorSearcher
from rankweave.sources.registry import lookup, read_registry, register_vectors


def vectors(spark):
    rows = [(i, [float(i), 1.0, 0.5], "a/model") for i in range(20)] + [(i, [1.0, float(i)], "b model") for i in range(7)]
    return spark.createDataFrame(rows, "id long, vec array<float>, model_name string")


def test_registry_rows_and_lookup(spark, tmp_path):
    root = str(tmp_path / "models")
    registry = register_vectors(vectors(spark), root, {"a/model": "/somewhere/index"})
    rows = {r.model_name: r for r in registry.collect()}
    assert (rows["a/model"].dimension, rows["a/model"].n_vectors, rows["a/model"].index_path) == (3, 20, "/somewhere/index")
    assert (rows["b model"].dimension, rows["b model"].n_vectors, rows["b model"].index_path) == (2, 7, None)
    assert lookup(spark, root, "b model").vectors_path.endswith("model=b-model")
    with pytest.raises(KeyError):
        lookup(spark, root, "no such model")
    assert read_registry(spark, root).count() == 2


def test_searcher_by_name_reads_its_model_alone(spark, tmp_path):
    root = str(tmp_path / "models")
    register_vectors(vectors(spark), root)
    searcher = VectorSearcher.by_name(spark, root, "b model", max_count=3)
    assert searcher.dimension == 2 and searcher.vectors.count() == 7
    queries = spark.createDataFrame([(1, [1.0, 6.0])], "query_id long, vec array<float>")
    hits = searcher.search(queries).ranked(3).collect()
    assert [r.id for r in hits] == [6, 5, 4]
    with pytest.raises(KeyError):
        VectorSearcher.by_name(spark, root, "a model", max_count=3)
