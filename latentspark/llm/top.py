"""The k smallest rows per key without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPREAD = 64


def smallest(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """Rows among the ``k`` first of their key in ``order``: first within hashed parts of the key,
    then among the survivors (at most SPREAD x k rows of a key)."""
    part = F.pmod(F.xxhash64(*order), F.lit(SPREAD))
    first = W.partitionBy(key, "_part").orderBy(*order)
    few = df.withColumn("_part", part).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    last = W.partitionBy(key).orderBy(*order)
    out = few.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= k)
    return out.select(*df.columns)
