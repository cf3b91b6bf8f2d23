"""Replicates, groups, prediction, segmentation, diagnostics and windows on known structures."""

import numpy as np
import pandas as pd
import pytest

from latentspark import diagnostics, extend, groups, predict, resample
from latentspark.model import fit
from latentspark.segment import Fimix
from latentspark.spec import Mode, PathModel, Paths, Scheme
from latentspark.streaming import fit_windows, windowed_moments, write_fits
from tests.test_model import data, ext, estimate, model


@pytest.fixture(scope="module")
def frame(spark):
    pdf = data(500).assign(id=range(500), grp=["a" if i % 3 else "b" for i in range(500)])
    return spark.createDataFrame(pdf).repartition(3).cache()


@pytest.fixture(scope="module")
def fitted(frame):
    return fit(frame, model(), Scheme.PATH, keep=["id"])


def test_bootstrap_does_not_depend_on_partitions(frame, fitted):
    one = {(r.kind, r.a, r.b): r for r in resample.summary(resample.bootstrap(fitted, "id", 100)).collect()}
    other = fit(frame.repartition(1), model(), Scheme.PATH, keep=["id"])
    two = {(r.kind, r.a, r.b): r for r in resample.summary(resample.bootstrap(other, "id", 100)).collect()}
    assert one.keys() == two.keys()
    for k, r in one.items():
        assert r.se == pytest.approx(two[k].se, abs=1e-9)
    path = one["path", "X", "M"]
    se = next(r[3] for r in fitted.tables.inner_model() if r[:2] == ("X", "M"))
    assert 0.6 * se < path.se < 1.6 * se and path.ci_percentile_lower < path.original < path.ci_percentile_upper


def test_inference_tables(fitted):
    r = resample.bootstrap(fitted, "id", 40)
    tables = resample.inference(r)
    assert list(tables) == list(resample.INFERENCE)
    assert tables["outerLoadings"].count() == 9 and tables["specificIndirectEffects"].first().via == "X -> M -> Y"
    again = {(x.kind, x.a, x.b): x.boot_mean for x in resample.summary(r).collect()}
    assert again["path", "X", "M"] == pytest.approx(tables["pathCoefficients"].filter("target = 'M'").first()["mean"])


def test_poisson_weights_have_mean_and_variance_one():
    w = resample.poisson_weights(np.arange(2000), np.arange(50), 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03


def test_permutation_and_bootstrap_of_like_groups(frame):
    two = [groups.Group("a", values=("a",)), groups.Group("b", values=("b",))]
    for r in groups.permutation_mga(frame, model(), "grp", two, "id", reps=60).collect():
        assert 0 < r.p_value <= 1 and r.valid == 60 and r.difference == pytest.approx(r.estimate_a - r.estimate_b)
    got = groups.bootstrap_mga(frame, model(), "grp", two, "id", reps=60).filter("kind = 'path'").collect()
    assert len(got) == 3 and all(r.p_1 < 0.05 or abs(r.original_1) < 0.4 for r in got)
    m = groups.micom(frame, model(), "grp", two, "id", reps=60)
    assert sum(m.group_sizes) == 500 and all(r.c > 0.98 for r in m.step2.collect())
    assert {r.invariance for r in m.summary.collect()} <= {"full", "partial", "none"}
    with pytest.raises(ValueError):
        groups.micom(frame, model(), "id", [groups.Group("a", low=0, high=9), groups.Group("b", low=5)], "id")


def test_range_wins_over_values(spark):
    df = spark.createDataFrame([("1",), ("5",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.filter(groups.Group("g", values=("x",), low=2).predicate(df.v)).collect()] == ["5"]


def test_prediction_beats_the_mean_and_matches_rows(frame, fitted):
    metrics, summary = predict.predict(fitted, "id", k=5)
    rows = metrics.collect()
    assert len(rows) == 6 and all(r.q2_predict > 0.1 and r.rmse_pls > r.mae_pls for r in rows)
    assert {r.pls_vs_lm for r in summary.collect()} <= {"better", "worse", "tie"}
    # the fold errors against plain numpy
    pdf = frame.toPandas()
    train = ext(pdf.drop(columns=["id", "grp"])).moments
    pls, linear, _ = predict.linear_predictions(fitted.model, train, Scheme.PATH, 1e-6, "direct")
    x = pdf[list(train.names)].to_numpy()
    by_rows = ((x[:, train.names.index("m1")] - pls[0, 0] - x @ pls[1:, 0]) ** 2).sum()
    assert predict.squared_error(train, train.names.index("m1"), pls[:, 0]) == pytest.approx(by_rows)
    want = np.linalg.lstsq(np.column_stack([np.ones(500), pdf[["x1", "x2", "x3"]]]), pdf["m1"], rcond=None)[0]
    np.testing.assert_allclose(linear[[0, *[1 + train.names.index(c) for c in ("x1", "x2", "x3")]], 0], want, atol=1e-9)


def test_blindfolding_equals_the_row_version(frame, fitted):
    got = {r.lv: r.q_squared for r in predict.q_squared(fitted, "id", 7).collect()}
    pdf = frame.toPandas().sort_values("id").reset_index(drop=True)
    cols, block = [c for c in pdf if c not in ("id", "grp")], ["m1", "m2", "m3"]
    sse = sso = 0.0
    for d in range(7):
        out = pdf["id"] % 7 == d
        filled = pdf[cols].copy()
        filled.loc[out, block] = pdf.loc[~out, block].mean().to_numpy()
        e = estimate(model(), ext(filled), Scheme.PATH)
        s, t = e.solution, e.tables
        z = (filled - filled.mean()) / filled.std()
        scores = z[s.mvs].to_numpy() @ (s.weights * s.signs)
        predicted = scores @ t.inner.paths[s.lvs.index("M")]
        for c in block:
            train = pdf.loc[~out, c]
            p = train.mean() + t.loading[s.mvs.index(c)] * train.std(ddof=0) * predicted[out]
            sse += ((pdf.loc[out, c] - p) ** 2).sum()
            sso += ((pdf.loc[out, c] - train.mean()) ** 2).sum()
    assert got["M"] == pytest.approx(1 - sse / sso, abs=1e-9)


def test_two_classes_are_told_apart(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(600)
    side = np.arange(600) % 2
    y = np.where(side, 0.9, -0.9) * x + 0.2 * rng.standard_normal(600)
    df = spark.createDataFrame(pd.DataFrame({"id": range(600), "x": x, "y": y}))
    m = PathModel.of(Paths([("X", "Y")])).with_block("X", Mode.A, "x").with_block("Y", Mode.A, "y")
    f = Fimix(fit(df, m, keep=["id"]), "id", 2, 60, 1e-4, 2)
    slopes = sorted(r.estimate for r in f.class_paths().filter("source = 'X'").collect())
    assert slopes[0] < -0.5 and slopes[1] > 0.5
    far = f.memberships().toPandas().set_index("id").loc[np.flatnonzero(np.abs(x) > 0.7)]
    agree = (far["class"] == far["class"].iloc[0]).to_numpy() == (side[far.index] == side[far.index[0]])
    assert agree.mean() > 0.95 and f.fit_criteria().first().en > 0.5


def test_tetrads_of_one_factor_vanish(spark):
    rng = np.random.default_rng(2)
    one = rng.standard_normal(800)
    pdf = pd.DataFrame({f"a{i}": 0.8 * one + 0.6 * rng.standard_normal(800) for i in range(4)} | {"y": one + rng.standard_normal(800), "id": range(800)})
    m = PathModel.of(Paths([("A", "Y")])).with_block("A", Mode.A, "a0", "a1", "a2", "a3").with_block("Y", Mode.A, "y")
    f = fit(spark.createDataFrame(pdf), m, keep=["id"])
    tetrads, summary = diagnostics.cta(f, "id", 200)
    assert summary.first().decision == "reflective supported" and abs(tetrads.first().tetrad) < 0.1
    assert diagnostics.holm([0.001, 0.04, 0.03], 0.05) == [True, False, False]


def test_copula_and_ipma(fitted):
    rows = diagnostics.copula(fitted, "id", "Y", reps=60)[0].collect()
    assert {r.predictor for r in rows} == {"X", "M"} and all(0 <= r.cvm_p_nonnormal <= 1 for r in rows)
    with pytest.raises(ValueError):
        diagnostics.copula(fitted, "id", "X")
    lvs, items = diagnostics.ipma(fitted, "Y")
    assert {r.lv for r in lvs.collect()} == {"X", "M"} and all(0 <= r.performance <= 100 for r in items.collect())
    assert set(diagnostics.report(fitted)) >= {"reliability", "paths", "fit_indices"}


def test_moderation_finds_an_interaction(spark):
    rng = np.random.default_rng(4)
    x, z = rng.standard_normal((2, 800))
    pdf = pd.DataFrame({"id": range(800), "x": x, "z": z, "y": 0.4 * x + 0.3 * z + 0.5 * x * z + 0.5 * rng.standard_normal(800)})
    m = PathModel.of(Paths([("X", "Y"), ("Z", "Y")]))
    for lv in "XZY":
        m = m.with_block(lv, Mode.A, lv.lower())
    got = extend.moderate(spark.createDataFrame(pdf), m, "X", "Z", "Y", Scheme.PATH).interaction_effect().first()
    assert got.estimate > 0.3 and got.p_value < 1e-6


def test_higher_order_two_ways(frame, fitted):
    made = extend.higher_order(fitted, "H", ["X", "M"], Mode.A, Paths([("H", "Y")]))
    assert made.type() == "I" and len(made.summary().collect()) == 2
    m = PathModel.of(Paths([("H", "Y")])).with_higher_order("H", Mode.A, ["X", "M"])
    for lv in "XMY":
        m = m.with_block(lv, Mode.A, *[f"{lv.lower()}{i}" for i in (1, 2, 3)])
    inside = fit(frame, m, Scheme.PATH, keep=["id"])
    a, b = (f.inner_model().first().estimate for f in (made.refit, inside))
    assert a == pytest.approx(b, abs=0.05)
    assert inside.scores(["id"]).count() == 500
    with pytest.raises(ValueError):
        extend.higher_order(fitted, "H", ["X"], Mode.A, Paths([("H", "Y")]))


def test_windows_in_batch_and_as_a_stream(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(400)
    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(400), unit="min"), "x": x, "y": x + 0.5 * rng.standard_normal(400)})
    m = PathModel.of(Paths([("X", "Y")])).with_block("X", Mode.A, "x").with_block("Y", Mode.A, "y")
    df = spark.createDataFrame(pdf)
    batch = {r.window_start: r.estimate for r in fit_windows(windowed_moments(df, "ts", ["x", "y"], "1 hour"), m).collect()}
    assert len(batch) == 7
    first = pdf[pdf.ts < "2024-01-01 01:00"]
    assert batch[pd.Timestamp("2024-01-01").to_pydatetime()] == pytest.approx(first.x.corr(first.y))
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    q = write_fits(stream, "ts", m, "1 hour", "10 minutes", str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    got = {r.window_start: r.estimate for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) >= 5 and all(got[k] == pytest.approx(batch[k]) for k in got)


def test_unfinished_latent_classes_are_flagged(spark, fitted):
    short, whole = Fimix(fitted, "id", 2, 10, 1e-12, 2), Fimix(fitted, "id", 2, tolerance=1.0, restarts=1)
    assert not short.converged and short.iterations == 10 and short.restarts_converged == 0
    assert whole.converged and whole.restarts_converged == 1 and whole.iterations < 500
    assert [r.converged for f in (short, whole) for r in f.fit_criteria().collect()] == [False, True]
    assert {r.converged for r in short.memberships().select("converged").collect()} == {False}


def test_latent_class_queries_use_the_defaults(monkeypatch):
    from latentspark.plans import pls

    seen = []

    class Recorded:
        def __init__(self, *a, **k):
            seen.append((a[1:], k))

        memberships = fit_criteria = lambda self: None

    monkeypatch.setattr(pls, "Fimix", Recorded)
    monkeypatch.setattr(pls, "fitted", lambda *a: None)
    pls.fimix_memberships(None, "")
    pls.fimix_criteria(None, "")
    assert seen == [(("row_id", 2), {})] * 2


def test_what_cannot_be_fitted_is_reported(spark, fitted, monkeypatch):
    from latentspark import model as model_module
    from latentspark.kernel.weights import NoConvergence
    from latentspark.plans import pls

    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(120), unit="min"), "x": [1.0] * 60 + list(range(60)), "y": np.arange(120.0)})
    m = PathModel.of(Paths([("X", "Y")])).with_block("X", Mode.A, "x").with_block("Y", Mode.A, "y")
    got = fit_windows(windowed_moments(spark.createDataFrame(pdf), "ts", ["x", "y"], "1 hour"), m).orderBy("window_start").collect()
    assert [(r.n, r.source, r.target, r.estimate is None) for r in got] == [(60, "X", "Y", True), (60, "X", "Y", False)]

    assert {r.skipped for r in predict.q_squared(fitted, "id", 7).collect()} == {0}
    calls, whole = [], predict.estimate

    def sometimes(*a):
        calls.append(a)
        if len(calls) == 1:
            raise NoConvergence("planted")
        return whole(*a)

    monkeypatch.setattr(predict, "estimate", sometimes)
    assert sorted(r.skipped for r in predict.q_squared(fitted, "id", 7).collect()) == [0, 1]
    monkeypatch.setattr(predict, "estimate", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        predict.q_squared(fitted, "id", 7)

    def never(*a):
        raise NoConvergence("planted")

    monkeypatch.setattr(pls, "satisfaction", lambda *a: None)
    monkeypatch.setattr(model_module, "prepare", lambda *a: fitted.prepared)
    monkeypatch.setattr(model_module, "estimate", never)
    rows = pls.scheme_paths(spark, "").collect()
    assert len(rows) == 5 and {r.status for r in rows} == {"planted"}


def test_resampling_queries_draw_the_defaults(monkeypatch):
    import inspect

    from latentspark import groups
    from latentspark.plans import pls

    class Drawn(Exception):
        pass

    def recorded(f):
        def run(*a, **k):
            bound = inspect.signature(f).bind(*a, **k)
            bound.apply_defaults()
            raise Drawn(bound.arguments["reps"])

        return run

    for module, name in ((resample, "bootstrap"), (groups, "permutation_mga"), (groups, "bootstrap_mga"), (groups, "micom"), (diagnostics, "cta"), (diagnostics, "copula")):
        monkeypatch.setattr(module, name, recorded(getattr(module, name)))
    monkeypatch.setattr(pls, "fitted", lambda *a: None)
    monkeypatch.setattr(pls, "satisfaction", lambda *a: None)
    want = {"bootstrap_summary": 5000, "inference_loadings": 5000, "permutation_mga": 5000, "bootstrap_mga": 5000, "micom": 1000, "tetrad_tests": 500, "copula": 500}
    for name, reps in want.items():
        with pytest.raises(Drawn) as e:
            pls.QUERIES[name](None, "")
        assert e.value.args == (reps,), name


def test_arguments_of_latent_classes_are_checked(fitted):
    for wrong in ((1,), (2, 9), (2, 500, 0.0), (2, 500, 1e-6, 0)):
        with pytest.raises(ValueError):
            Fimix(fitted, "id", *wrong)


def test_errors_within_the_sample_use_the_scores_of_the_fit(fitted):
    metrics = {r.indicator: r for r in predict.predict(fitted, "id", 5)[0].collect()}
    rows = fitted.scores(["id"]).toPandas().set_index("id").sort_index()
    items = fitted.data().toPandas().set_index("id").sort_index()
    loading = {r[0]: (r[1], r[3]) for r in fitted.tables.outer_model()}
    for mv, r in metrics.items():
        lv, x = loading[mv]
        y = items[mv].to_numpy()
        e = y - (y.mean() + x * y.std() * rows[lv].to_numpy())
        assert r.rmse_pls_in == pytest.approx(np.sqrt((e**2).mean()), rel=1e-8)
        assert r.mae_pls_in == pytest.approx(np.abs(e).mean(), rel=1e-8)


def test_skipped_folds_count_neither_errors_nor_rows(fitted, monkeypatch):
    from latentspark.kernel.weights import NoConvergence

    whole, calls = predict.linear_predictions, []

    def first_fails(*a, **k):
        calls.append(1)
        if len(calls) == 1:
            raise NoConvergence("planted")
        return whole(*a, **k)

    plain = {r.indicator: r.rmse_pls for r in predict.predict(fitted, "id", 5)[0].collect()}
    monkeypatch.setattr(predict, "linear_predictions", first_fails)
    got, says = predict.predict(fitted, "id", 5)
    assert {r.skipped for r in says.collect()} == {1}
    assert all(r.rmse_pls == pytest.approx(plain[r.indicator], rel=0.15) for r in got.collect())


def test_inference_p_values_are_counted_from_draws(fitted):
    r = resample.bootstrap(fitted, "id", 99)
    table = {x.indicator: x for x in resample.inference(r)["outerLoadings"].collect()}
    draws = r.draws.filter("kind = 'loading'").toPandas()
    for mv, x in table.items():
        v = draws[draws.b == mv]["value"].to_numpy()
        v = np.where(np.abs(v + x.original) < np.abs(v - x.original), -v, v)
        assert x.p_value == pytest.approx((1 + (np.abs(v - v.mean()) >= abs(x.original)).sum()) / 100)


def test_bias_correction_falls_back_to_percentiles():
    v = np.arange(100.0)
    assert resample.bias_corrected(v, -1.0, 0.1) == pytest.approx(np.quantile(v, [0.05, 0.95]).tolist())
    assert resample.bias_corrected(v, 50.0, 0.1) == pytest.approx(np.quantile(v, [0.05, 0.95]).tolist(), abs=0.2)


def test_ordinal_and_nominal_replicates_equal_refits(spark):
    from latentspark.spec import Indicator, Scale

    rng = np.random.default_rng(5)
    f = rng.normal(size=300)
    pdf = pd.DataFrame({"id": range(300), "a": np.digitize(f + rng.normal(size=300) / 2, [-1, 0, 1]).astype(float), "b": np.digitize(f + rng.normal(size=300), [-0.5, 0.5]).astype(float), "y": f + rng.normal(size=300), "g": np.where(rng.random(300) < 0.5, "u", "v")})
    m = PathModel.of(Paths([("X", "Y")]), default_scale=Scale.NUM)
    m = m.with_block("X", Mode.A, Indicator("a", Scale.ORD), Indicator("b", Scale.NOM)).with_block("Y", Mode.A, "y")
    df = spark.createDataFrame(pdf)
    r = resample.bootstrap(fit(df, m, Scheme.CENTROID, keep=["id"]), "id", 4, 3)
    got = {(x.rep, x.a, x.b): x.value for x in r.draws.filter("kind = 'path'").collect()}
    hashes = [x[0] for x in df.selectExpr("xxhash64(id) as h", "id").orderBy("id").collect()]
    w = resample.poisson_weights(np.array(hashes), np.arange(4), 3).astype(int)
    for rep in range(4):
        again = fit(spark.createDataFrame(pdf.loc[np.repeat(pdf.index, w[rep])]), m, Scheme.CENTROID)
        assert got[rep, "X", "Y"] == pytest.approx(again.tables.inner_model()[0][2], abs=1e-6)
    two = [groups.Group("u", values=("u",)), groups.Group("v", values=("v",))]
    p = groups.permutation_mga(df, m, "g", two, "id", reps=40).collect()
    assert len(p) == 1 and p[0].valid == 40
    with pytest.raises(ValueError):
        groups.micom(df, m, "g", two, "id", reps=40)


def test_normality_p_values_of_small_samples():
    from latentspark.kernel.dist import cramer_von_mises_from_statistic

    u = np.sort(np.random.default_rng(1).random((100_000, 5)), 1)
    w = 1 / 60 + ((u - (2 * np.arange(1, 6) - 1) / 10) ** 2).sum(1)
    for p in (0.5, 0.1, 0.01):
        assert cramer_von_mises_from_statistic(float(np.quantile(w, 1 - p)), 5) == pytest.approx(p, abs=0.006)


def test_windows_of_few_rows_come_out_without_estimates(spark):
    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta([0, 1, *range(60, 90)], unit="min"), "x": np.arange(32.0), "y": np.arange(32.0) ** 2})
    m = PathModel.of(Paths([("X", "Y")])).with_block("X", Mode.A, "x").with_block("Y", Mode.A, "y")
    got = fit_windows(windowed_moments(spark.createDataFrame(pdf), "ts", ["x", "y"], "1 hour"), m).orderBy("window_start").collect()
    assert [(r.n, r.estimate is None, r.status) for r in got] == [(2, True, "too few rows"), (30, False, "ok")]


def test_higher_order_constructs_can_be_nested(spark):
    rng = np.random.default_rng(8)
    g = rng.normal(size=500)
    cols = {f"{p}{i}": g * w + rng.normal(size=500) * 0.6 for p, w in (("a", 0.9), ("b", 0.8), ("c", 0.7)) for i in (1, 2)}
    cols |= {f"y{i}": 0.6 * g + rng.normal(size=500) * 0.6 for i in (1, 2)}
    df = spark.createDataFrame(pd.DataFrame(cols))
    m = PathModel.of(Paths([("A", "Y"), ("B", "Y"), ("C", "Y")]))
    for lv in "ABCY":
        m = m.with_block(lv, Mode.A, f"{lv.lower()}1", f"{lv.lower()}2")
    first = extend.higher_order(fit(df, m, Scheme.PATH), "AB", ["A", "B"], Mode.A, Paths([("AB", "Y"), ("C", "Y")]))
    second = extend.higher_order(first.refit, "ABC", ["AB", "C"], Mode.A, Paths([("ABC", "Y")]))
    assert {r.first_order for r in second.summary().collect()} == {"AB", "C"} and second.type() == "I"
    path = second.refit.tables.inner_model()[0]
    direct = np.corrcoef(np.sum([cols[k] for k in cols if k[0] != "y"], 0), cols["y1"] + cols["y2"])[0, 1]
    assert path[:2] == ("ABC", "Y") and path[2] == pytest.approx(direct, abs=0.05)
