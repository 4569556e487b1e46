"""The embedding extension point: text in, one float vector out, per Arrow batch."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SIMPLE_TOKEN


class Embedder(ABC):
    """Shipped to the workers; ``load`` runs once per task, so put models there."""

    model_name: str
    dimension: int

    @abstractmethod
    def load(self) -> Callable[[Sequence[str]], np.ndarray]:
        """Return a function from texts to an array of shape (texts, dimension)."""

    def load_query(self) -> Callable[[Sequence[str]], np.ndarray]:
        """As ``load``, for queries; models with a query prefix override it."""
        return self.load()


@lru_cache(maxsize=200_000)
def _slot(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


class HashingEmbedder(Embedder):
    """Term counts hashed into slots, scaled to unit length.  Needs no weights."""

    def __init__(self, dimension: int = 64, model_name: str = "hashing"):
        self.dimension = dimension
        self.model_name = model_name

    def load(self) -> Callable[[Sequence[str]], np.ndarray]:
        pattern = regex.compile(SIMPLE_TOKEN)

        def run(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dimension))
            for row, text in enumerate(texts):
                for token, n in Counter(pattern.findall(text.lower())).items():
                    out[row, _slot(token) % self.dimension] += n
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(length > 0, length, 1.0)

        return run


def embed(col: Column, embedder: Embedder, *, is_query: bool = False) -> Column:
    """Embed a text column; null text gives a null vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder.load_query() if is_query else embedder.load()
        for texts in batches:
            out: list[np.ndarray | None] = [None] * len(texts)
            present = np.flatnonzero(texts.notna())
            if len(present):
                vectors = np.asarray(model(texts.iloc[present].tolist()), dtype="float32")
                if vectors.shape[1] != embedder.dimension:
                    raise ValueError(f"{embedder.model_name}: {vectors.shape[1]} values, not {embedder.dimension}")
                for row, vector in zip(present, vectors):
                    out[row] = vector
            yield pd.Series(out, dtype=object)

    return run(col)
