"""Distributed prefix sums and ranks against plain Python."""

import random

from pyspark.sql import functions as F

from latentspark.diagnostics import average_ranks
from latentspark.operators.ranks import buckets_for, hash_prefix


def test_prefix_sums(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", None]), i, rnd.choice([0, 1, 5, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id long, w long").withColumn("h", F.xxhash64("id"))
    for buckets in (1, 7):
        got = hash_prefix(df, ["k"], "h", "id", F.col("w"), buckets).collect()
        assert len(got) == len(rows)
        for k in ("a", None):
            total = 0
            for r in sorted((r for r in got if r.k == k), key=lambda r: (r.h, r.id)):
                assert r.before == total
                total += r.w or 0
    assert hash_prefix(df.limit(0), ["k"], "h", "id", F.col("w"), 1).count() == 0
    assert (buckets_for(0), buckets_for(100_001)) == (1, 3)


def test_average_ranks_with_ties(spark):
    values = [3.0, 1.0, 3.0, None, float("nan"), -2.0, 3.0]
    got = {r["value"]: (r["n"], r["below"], r["rank"]) for r in average_ranks(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()}
    assert got == {-2.0: (1, 0, 1.0), 1.0: (1, 1, 2.0), 3.0: (3, 2, 4.0)}
    assert average_ranks(spark.createDataFrame([], "x double"), "x").count() == 0
