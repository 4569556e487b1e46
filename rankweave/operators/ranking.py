"""Top-k and dense ranks per query that never sort a whole query in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Up to this k Spark keeps only k rows per key before the shuffle.
GROUP_LIMIT = 1000
SHARDS = 64


def top_k(df: DataFrame, k: int, order: Sequence[Column], keys: Sequence[str] = ("query_id",), rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key, numbered from 1 in ``rank``."""
    if k > GROUP_LIMIT:
        # The optimizer gives up here, so cut every shard of a key first.
        shard = F.pmod(F.xxhash64("id"), F.lit(SHARDS))
        local = W.partitionBy(*keys, "_shard").orderBy(*order)
        df = df.withColumn("_shard", shard).withColumn("_n", F.row_number().over(local))
        df = df.filter(F.col("_n") <= k).drop("_shard", "_n")
    final = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)


def dense_ranks(df: DataFrame, value: str, descending: bool, rank: str = "rank") -> DataFrame:
    """Dense rank of ``value`` within a query, for lists known to be short."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return df.withColumn(rank, F.dense_rank().over(W.partitionBy("query_id").orderBy(order)))


def dense_ranks_unbounded(
    df: DataFrame, value: str, descending: bool, rank: str = "rank", tasks: int | None = None
) -> DataFrame:
    """Dense rank for lists of any length; like the other form, of values that aren't null.

    The rank of a value is the number of distinct values before it.  Rows are dealt once, by
    thousandths of the value, over ``tasks`` tasks; each thousandth is ranked where it lies, and
    its highest rank is its number of distinct values.  The running total per query then covers
    slices, whose number follows from the value range and not from the rows.
    """
    sign = -1 if descending else 1
    sliced = df.withColumn("_slice", F.floor(F.col(value) * (1000 * sign)).cast("bigint"))
    keys = ["query_id", "_slice"]
    # The join below would drop such rows, on one of its sides before they are dealt.
    sliced = sliced.where(F.col("query_id").isNotNull() & F.col("_slice").isNotNull())
    dealt = sliced.repartition(*keys) if tasks is None else sliced.repartition(tasks, *keys)
    within = W.partitionBy(*keys).orderBy(F.col(value) * sign)
    ranked = dealt.withColumn("_in", F.dense_rank().over(within))
    # The id is named so that both readers of the dealt rows want the same columns and share them.
    slices = ranked.groupBy(*keys).agg(F.max(F.struct("_in", "id")).getField("_in").alias("_n"))
    before = W.partitionBy("query_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = ranked.join(slices, keys)
    return found.withColumn(rank, F.col("_before") + F.col("_in")).drop("_slice", "_in", "_before")
