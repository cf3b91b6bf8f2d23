"""Samples and mixes: shares, minimums, caps and exact cuts."""

import pytest
from pyspark.sql import functions as F

from latentspark.llm import mix, sample

PLAN = "plan_id long, tbl string, study_no int, category string, target_pct int, sample_rows int, min_rows int, available string"


def units(spark, sizes):
    rows = [("t", 1, c, k * 1000 + i) for k, (c, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows + [("t", 1, None, 9)], "tbl string, study_no int, category string, unit long")


def test_shares_minimums_and_report(spark):
    u = units(spark, {"a": 500, "b": 90, "c": 6})
    plans = spark.createDataFrame([(1, "t", 1, "a", 60, 100, 2, "x"), (1, "t", 1, "b", 39, 100, 2, "x"), (1, "t", 1, "c", 1, 100, 5, "x"), (2, "t", 1, "a", 10, 100, 0, "x"), (2, "t", 1, "c", 90, 100, 0, "x"), (3, "t", 7, "a", 100, 10, 0, "x")], PLAN)
    s = sample.CategorySample(u, plans)
    drawn = s.draw().toPandas()
    assert not drawn.duplicated(["plan_id", "unit"]).any()
    n = drawn.groupby(["plan_id", "category"]).size().to_dict()
    assert n == {(1, "a"): 60, (1, "b"): 39, (1, "c"): 5, (2, "a"): 10, (2, "c"): 6}
    assert drawn[(drawn.how == "floor")].category.unique().tolist() == ["c"]
    report = {(r.plan_id, r.category): r for r in s.report().collect()}
    assert {k for k, r in report.items() if not r.met} == {(2, "c"), (3, "a")}
    assert all(report[k].selected == v for k, v in n.items()) and report[3, "a"].selected == 0
    assert report[1, "a"].reached_pct == pytest.approx(100 * 60 / 104)
    told = {(r.plan_id, r.category): (r.drawn, r.exhausted) for r in s.drawn().collect()}
    assert told == {k: (n.get(k, 0), not r.met) for k, r in report.items()}


def test_fractional_targets_take_the_integers_around(spark):
    u = units(spark, {"a": 50, "b": 50, "c": 50})
    plans = spark.createDataFrame([(p, "t", 1, c, w, 7, 0, "x") for p in range(40) for c, w in (("a", 33), ("b", 33), ("c", 34))], PLAN)
    n = sample.CategorySample(u, plans).draw().groupBy("plan_id", "category").count().toPandas()
    assert set(n["count"]) <= {2, 3} and (n.groupby("plan_id")["count"].sum() == 7).all()
    picked = sample.CategorySample(u, plans).draw().groupBy("unit").count()
    assert picked.count() > 120  # plans of a study differ


def test_places_are_the_crossings_of_the_prefix_sums(spark):
    """Against a walk over every unit's rank."""
    import math

    u = units(spark, {"a": 97, "b": 13, "c": 5, "d": 1})
    plans = spark.createDataFrame([(p, "t", 1, c, w, n, m, "x") for p, n in enumerate((1, 10, 40, 100, 300)) for c, w, m in (("a", 61, 2), ("b", 30, 6), ("c", 8, 3), ("d", 1, 1))], PLAN)
    s = sample.CategorySample(u, plans)
    got: dict = {}
    for r in s.places().collect():
        got.setdefault((r.plan_id, r.category, r.how), set()).add(r.place)
    turns = {r.plan_id: r.t for r in plans.selectExpr("plan_id", "xxhash64('turn', plan_id) as t").distinct().collect()}
    for p in s.plans.join(s.report().select("plan_id", "category", "crossed", "selected"), ["plan_id", "category"]).collect():
        upto = [math.floor(p.ahead + k * p.wanted / p.available + p.start + 1e-9) for k in range(p.available + 1)]
        hits = [k for k in range(p.available) if upto[k + 1] > upto[k]]
        rest = [k for k in range(p.available) if k not in hits][: p.selected - p.crossed]
        for how, ranks in (("systematic", hits), ("floor", rest)):
            assert got.get((p.plan_id, p.category, how), set()) == {(k - turns[p.plan_id] % p.available) % p.available for k in ranks}


def test_unit_categories(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, None), (1, 6, "b"), (1, 6, "b"), (1, 6, "a"), (1, 7, None), (1, None, "a")], "study_no int, obs_id long, c string")
    got = sorted((r.unit, r.category) for r in sample.unit_categories(df, "t", F.col("c")).collect())
    assert got == [(5, "a"), (6, "b")]
    assert sample.CategorySample(units(spark, {"a": 3}).limit(0), spark.createDataFrame([], PLAN)).draw().count() == 0


def test_mix_keeps_caps_and_shares(spark):
    docs = spark.createDataFrame([(i, "big" if i % 3 else "small", 10 + i % 5) for i in range(3000)], "doc_id long, source string, tokens long").withColumn("before", F.lit(1))
    targets = spark.createDataFrame([(1, "big", 50, 2), (1, "small", 50, 2), (2, "small", 90, 1), (2, "none", 10, 5), (3, "big", 30, 1)], "mix_id int, source string, target_pct int, max_repeats int")
    plan = mix.shares(docs, targets)
    p = {(r.mix_id, r.source): r for r in plan.collect()}
    assert [k for k in sorted(p) if not p[k].met] == [(2, "none"), (2, "small")]
    chosen = mix.mix(docs, plan, "doc_id")
    got = {(r.mix_id, r.source): r for r in mix.reached(chosen, plan).collect()}
    for k, r in p.items():
        assert r.budget <= got[k].tokens < r.budget + 15 or r.budget == got[k].tokens == 0
        assert got[k].most_copies <= r.max_repeats
    assert got[1, "big"].reached_pct == pytest.approx(50, abs=0.2)
    assert {k for k, r in got.items() if r.short} == {(2, "none"), (2, "small")}
    per = chosen.filter("mix_id = 1 AND source = 'small'").agg(F.min("copies"), F.max("copies"), F.count("*")).first()
    assert tuple(per)[:2] == (1, 2) and per[2] == 1000
    assert mix.shares(docs.limit(0), targets).filter("NOT met").count() == 0


def test_source_spellings(spark):
    df = spark.createDataFrame([(" Preprint-Mirror\t",), ("preprint_mirror",), (None,)], "s string")
    assert [r[0] for r in df.select(mix.source_key(F.col("s"))).collect()] == ["preprint_mirror", "preprint_mirror", None]


def test_token_counts(spark):
    import base64
    import os

    import tiktoken

    path = f"{mix.TOKENIZERS}/{mix.VOCABULARY}"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    texts = ["Hello world, it's 2024!", "", None, "über große Wörter " * 20_000, "x" * 300_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = dict(map(tuple, mix.count_tokens(df, "text").collect()))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=mix.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got[0] == len(e.encode_ordinary(texts[0])) and got[1] == got[2] == 0
    assert got[3] == len(e.encode_ordinary(texts[3])) and got[4] == len(e.encode_ordinary(texts[4]))
    odd = "a  b\n\nc d's 12 it's\t x,y .. " * 40 + "z" * 50 + " \u00a0 end"
    for chunk in (1, 2, 7, 60, 200):
        assert "".join(mix.pieces(odd, chunk)) == odd
        assert sum(len(e.encode_ordinary(x)) for x in mix.pieces(odd, chunk)) == len(e.encode_ordinary(odd))
