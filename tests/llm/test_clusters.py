"""Grid clusters against brute force over the dense cells, and planted groups."""

import numpy as np
from pyspark.sql import functions as F

from latentspark.llm import clusters
from latentspark.llm.top import smallest


def planted(spark, n=1500):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((n, 2)) * 0.3
    angle = rng.random(n) * np.pi
    b = np.stack([3 * np.cos(angle), 3 * np.sin(angle)], 1) + rng.standard_normal((n, 2)) * 0.1
    c = rng.random((n // 15, 2)) * 8 - 4
    x = np.concatenate([a, b, c])
    rows = [(i, float(p[0]), float(p[1]), "n") for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x double, y double, label string"), n


def test_planted_groups_come_out_whole(spark):
    df, n = planted(spark)
    got = clusters.clusters(df, {"x": F.col("x"), "y": F.col("y")}, "id", typical=3).toPandas()
    big = got[got.id < 2 * n]
    names = [set(big[(big.id < n)].label), set(big[big.id >= n].label)]
    assert all(len(s) == 1 for s in names) and names[0] != names[1]
    assert len(big) > 0.9 * 2 * n and (got.id >= 2 * n).mean() < 0.05
    assert got.groupby("label").typical.sum().tolist() == [3, 3]
    # sizes count a cluster's records
    assert all(len(g) == g["size"].iloc[0] for _, g in got.groupby("label"))
    centre = got[got.typical & (got.id < n)].id
    assert len(centre) == 3


def test_labels_equal_a_flood_fill(spark):
    rng = np.random.default_rng(3)
    cells = sorted({tuple(map(int, c)) for c in rng.integers(0, 14, (70, 2))})
    df = spark.createDataFrame(cells, "a long, b long")
    got = {(r.a, r.b): r.label for r in clusters.label_components(df, ["a", "b"]).collect()}
    parent = {c: c for c in cells}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for p in cells:
        for q in cells:
            if max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1:
                parent[root(p)] = root(q)
    for p in cells:
        for q in cells:
            assert (got[p] == got[q]) == (root(p) == root(q))


def test_a_long_chain_settles(spark):
    df = spark.createDataFrame([(i,) for i in range(150)], "a long")
    assert clusters.label_components(df, ["a"]).select("label").distinct().count() == 1


def test_odd_tables(spark):
    df, _ = planted(spark, 30)
    on = {"x": F.col("x"), "y": F.col("y")}
    assert clusters.clusters(df.limit(0), on, "id").count() == 0
    assert clusters.clusters(df.withColumn("x", F.lit(None).cast("double")), on, "id").count() == 0
    same = spark.createDataFrame([(1, 1.0, 1.0)] * 9, "id long, x double, y double")
    got = clusters.clusters(same, on, "id", typical=9)
    assert got.count() >= 9 and got.select("label").distinct().count() == 1


def test_smallest(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(300)], "k int, v double")
    assert sorted((r.k, r.v) for r in smallest(df, "k", ["v"], 2).collect()) == [(0, 0.0), (0, 2.0), (1, 1.0), (1, 3.0)]


def test_small_dense_clusters_stay_however_large_the_table(spark):
    rng = np.random.default_rng(7)
    big, small = rng.standard_normal((30_000, 2)) * 0.5, np.array([6.0, 6.0]) + rng.standard_normal((40, 2)) * 0.01
    far = rng.random((300, 2)) * 16 - 8
    x = np.concatenate([big, small, far])
    df = spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(x)], "id long, x double, y double")
    got = clusters.clusters(df, {"x": F.col("x"), "y": F.col("y")}, "id").toPandas()
    tight = got[got.id.between(30_000, 30_039)]
    assert len(tight) == 40 and tight.label.nunique() == 1 and 40 <= tight["size"].iloc[0] < 60


def test_many_equal_clusters_stay(spark):
    rows = [(40 * c + i, float(c % 10), float(c // 10 % 10), float(c // 100)) for c in range(1000) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = clusters.clusters(df, {n: F.col(n) for n in "xyz"}, "id").toPandas()
    assert len(got) == 40_000 and got.label.nunique() == 1000 and set(got["size"]) == {40}


def test_scattered_records_form_no_cluster(spark):
    x = np.random.default_rng(11).random((20_000, 3)) * 10
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")
    grid = clusters.GridClusters(df, {c: F.col(c) for c in "xyz"}, "id", noise_share=1.0)
    assert grid.labelled.count() == 0
