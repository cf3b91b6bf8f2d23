"""Chow-Liu filling: the tree against brute force, accuracy on held-out cells, odd input."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from latentspark.operators import impute
from latentspark.operators.impute import Field, FillSpec, Tree

COUNTS = {(0, 1): np.array([[40.0, 10], [5, 45]]), (0, 2): np.array([[30.0, 20], [25, 25]]), (1, 2): np.array([[44.0, 1], [6, 49]])}


def test_tree_has_the_most_information():
    edges = {tuple(sorted(e)) for e in impute.chow_liu(COUNTS, 3)}
    best = max(itertools.combinations(COUNTS, 2), key=lambda pair: sum(impute.mutual_information(COUNTS[p]) for p in pair))
    assert edges == set(best)


def test_messages_give_the_exact_posterior():
    rng = np.random.default_rng(1)
    joint = {(0, 1): rng.random((2, 3)), (1, 2): rng.random((3, 2)), (1, 3): rng.random((3, 4))}
    first = joint[0, 1].sum(1)
    tree = Tree(list("abcd"), [2, 3, 2, 4], list(joint), joint, [first / first.sum(), np.ones(3) / 3, np.ones(2) / 2, np.ones(4) / 4], {})
    conditional = {e: t / t.sum(1, keepdims=True) for e, t in joint.items()}
    for seen in ((-1, -1, 1, 2), (-1, -1, -1, 0), (-1, 2, 0, -1)):
        p = np.zeros(2)
        for x in itertools.product(range(2), range(3), range(2), range(4)):
            if all(s < 0 or s == v for s, v in zip(seen, x)):
                p[x[0]] += tree.marginal[0][x[0]] * conditional[0, 1][x[0], x[1]] * conditional[1, 2][x[1], x[2]] * conditional[1, 3][x[1], x[3]]
        got = impute.posterior(tree, np.array([seen]), 0, {})[0]
        np.testing.assert_allclose(got, p / p.sum(), atol=1e-12)


def survey(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    level = rng.integers(1, 8, n)
    a = np.clip(level + rng.integers(-1, 2, n), 1, 7)
    b = np.clip(level + rng.integers(-1, 2, n), 1, 7)
    person = rng.integers(0, n // 4, n)
    kind = np.where(person % 3 == 0, "x", "y")
    hide = rng.random(n) < 0.1
    rows = [(i, int(person[i]), None if hide[i] else int(a[i]), int(b[i]), None if hide[i] else str(kind[i]), int(a[i]), str(kind[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, person long, a int, b int, kind string, truth int, true_kind string")
    spec = FillSpec("id", (Field("a", 1, 7), Field("b", 1, 7), Field("kind", labels=("x", "y"))), ("a", "kind"), {"person": ("person",)}, "person", ("kind",))
    return df, spec


def test_held_out_cells_are_filled_well_and_marked(spark):
    df, spec = survey(spark)
    full = impute.fill_missing(df, spec)
    hidden = full.filter("a_filled")
    assert hidden.count() == df.filter("a IS NULL").count() and full.filter("a IS NULL OR kind IS NULL").count() == 0
    error = hidden.agg(F.avg(F.abs(F.col("a").cast("int") - F.col("truth")))).first()[0]
    guess = df.agg(F.avg(F.abs(F.col("truth") - 4))).first()[0]
    assert error < 0.6 * guess
    assert hidden.agg(F.avg((F.col("kind") == F.col("true_kind")).cast("double"))).first()[0] > 0.9
    assert full.filter("NOT a_filled AND a <> truth").count() == 0


def test_known_fill_is_the_unanimous_answer(spark):
    rows = [(1, 1, None, None), (2, 1, 3, "x"), (3, 1, 4, "x"), (4, 2, None, None), (5, 2, 2, "x"), (6, 2, 2, "y"), (7, None, None, None), (7, None, None, None)]
    df = spark.createDataFrame(rows, "id long, person long, a int, kind string").withColumn("b", F.lit(99)).withColumn("_f0", F.lit(1)).withColumn("value", F.lit("!"))
    _, spec = survey(spark, 10)
    got = sorted((r.row_id, r.fld, r.known_fill, r.value is not None) for r in impute.filled_cells(df, spec).collect())
    assert got == [(1, "a", "", True), (1, "kind", "x", True), (4, "a", "", True), (4, "kind", "", True)] + [(7, "a", "", True)] * 2 + [(7, "kind", "", True)] * 2


def test_empty_table(spark):
    df, spec = survey(spark, 10)
    assert impute.filled_cells(df.limit(0), spec).count() == 0


def test_wide_scales_are_binned():
    f = Field("x", 0, 99)
    assert f.bins == impute.MAX_BINS and 0 <= int(f.value(0)) < 7 and int(f.value(15)) > 92


def test_certain_evidence_decides_and_held_out_answers_come_back(spark):
    post = np.array([[0.7, 0.2, 0.1], [0.7, 0.2, 0.1]])
    sure = impute.with_certain(post, np.array([-1, 2]))
    np.testing.assert_allclose(sure, [[0.7, 0.2, 0.1], [0, 0, 1]])
    assert impute.decode(sure, True).tolist() == [0, 2] and impute.decode(sure, False).tolist() == [0, 2]
    df = spark.range(2000).selectExpr("id AS row_id", "cast(id % 5 + 1 AS int) AS a", "cast(id % 5 + 1 AS int) AS b", "'x' AS truth")
    spec = FillSpec("row_id", (Field("a", 1, 5), Field("b", 1, 5)), ("a",))
    r = impute.held_out(df, spec).collect()
    assert len(r) == 1 and 100 < r[0].cells < 300 and r[0].tree_right == 1.0 and r[0].mode_right < 0.4 and r[0].tree_error == 0.0


def test_many_labels_are_evidence_by_hash(spark):
    f = Field("k", labels=tuple(str(i) for i in range(1000)))
    df = spark.range(300).selectExpr("id AS row_id", "cast(id AS string) AS k", "cast(id % 3 + 1 AS int) AS a")
    assert f.bins == impute.MAX_LABELS
    cells = impute.filled_cells(df.withColumn("a", F.when(F.col("row_id") > 5, F.col("a"))), FillSpec("row_id", (Field("a", 1, 3), f), ("a",))).collect()
    assert len(cells) == 6


def test_what_groups_say_is_broadcast_by_its_size(spark):
    labels = tuple(str(i) for i in range(200))
    df = spark.range(60_000).selectExpr("id AS row_id", "id % 40000 AS person", "CASE WHEN id >= 20 THEN cast(id % 40000 % 200 AS string) END AS k", "cast(id % 3 + 1 AS int) AS b")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = impute.filled_cells(df, FillSpec("row_id", (Field("k", labels=labels), Field("b", 1, 3)), ("k",), {"person": ("person",)}, "person", ("k",)))
        # 40,000 groups of 200 counts each
        assert "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.row_id, r.known_fill) for r in cells.collect()) == [(i, str(i % 200)) for i in range(20)]
        few = impute.filled_cells(df.filter("person < 10"), FillSpec("row_id", (Field("k", labels=labels), Field("b", 1, 3)), ("k",), {"person": ("person",)}, "person", ("k",)))
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
