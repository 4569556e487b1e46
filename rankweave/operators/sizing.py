"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
# An id, a query id, a score and the row header.
HIT_BYTES = 48
# Pairs of a document and a query that a task scores at once; each is a row of its hash table.
PAIRS_PER_TASK = 500_000
# More tasks than this cost more than they save; their tables spill instead.
MOST_TASKS = 20_000


def scoring_tasks(documents: int, queries: int) -> int:
    """Tasks that score all documents for all queries, so that what one holds doesn't grow with either."""
    return max(1, min(MOST_TASKS, -(-documents * max(1, queries) // PAIRS_PER_TASK)))


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def fits(self, limit: int = BROADCAST_BYTES) -> bool:
        return self.bytes <= limit


def measure(df: DataFrame, payload: Column | None = None) -> Size:
    """Count a frame's rows and bytes; ``payload`` is the variable-length part."""
    extra = F.lit(0) if payload is None else payload
    row = df.agg(F.count("*").alias("n"), F.sum(extra).alias("b")).first()
    return Size(row.n, row.n * HIT_BYTES + int(row.b or 0))


def broadcast_if(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """Inner equi-join that splits every key of ``big`` over ``salts`` tasks.

    ``small`` is copied ``salts`` times; ``spread`` is what tells apart the rows
    of ``big`` under one key.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return left.join(small.withColumn("_salt", copies), [*on, "_salt"]).drop("_salt")
