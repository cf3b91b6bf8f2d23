"""Prefix sums and ranks inside groups of any size, without one task per group.

A window over a group sorts the whole group in one task. Here each group is cut into hash ranges
("buckets") first: the sums of all buckets are prefix-summed (a table of groups x buckets rows), and
only the rows of one bucket are ever sorted together. With hashes spread evenly over ``buckets``
ranges a task holds about group rows / buckets, whatever the share of the group in the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS = 50_000


def buckets_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Ranges needed so that even a group of all rows has about ``bucket_rows`` in each."""
    return max(1, -(-rows // bucket_rows))


def hash_prefix(df: DataFrame, keys: list[str], order: str, tie: str, weight: Column, buckets: int) -> DataFrame:
    """``df`` with ``before``: the sum of ``weight`` over rows of the same keys that sort earlier.

    Rows sort by the long column ``order`` (a hash, spread over all longs) and then by ``tie``,
    which must differ within a group. NULL keys form a group of their own; an empty input gives an
    empty output. Weights must not be negative; NULL counts as 0.
    """
    w = F.coalesce(weight.cast("bigint"), F.lit(0).cast("bigint"))
    # unsigned order: shift by 2**63 in double precision is enough to find the range, ties stay inside
    place = (F.col(order).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    bucket = F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("int")
    with_bucket = df.withColumn("_bucket", bucket).withColumn("_weight", w)
    sums = with_bucket.groupBy(*keys, "_bucket").agg(F.sum("_weight").alias("_in_bucket"))
    ahead = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_in_bucket").over(ahead), F.lit(0)).alias("_ahead"),
    )
    match = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(order, tie).rowsBetween(W.unboundedPreceding, -1)
    running = with_bucket.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    joined = running.join(sums, match)
    return joined.select(*df.columns, (F.col("_ahead") + F.col("_inside")).alias("before"))
