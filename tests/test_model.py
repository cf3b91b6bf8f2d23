"""Path models: numpy brute force, identities and recovery of known paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from latentspark import moments as M
from latentspark.kernel import dist
from latentspark.kernel.weights import Extended, monotone
from latentspark.model import estimate, fit
from latentspark.resample import bootstrap, henseler_p, parametric_t, welch_t
from latentspark.spec import Indicator, Mode, PathModel, Paths, Scale, Scheme

EDGES = [("X", "M"), ("M", "Y"), ("X", "Y")]


def data(n=600, seed=0, loads=(0.85, 0.78, 0.82)):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal(n)
    m = 0.6 * x + 0.8 * rng.standard_normal(n)
    y = 0.55 * m + 0.25 * x + 0.6 * rng.standard_normal(n)
    out = {}
    for name, v in (("x", x), ("m", m), ("y", y)):
        v = (v - v.mean()) / v.std()
        for i, w in enumerate(loads):
            out[f"{name}{i + 1}"] = w * v + np.sqrt(1 - w * w) * rng.standard_normal(n)
    return pd.DataFrame(out)


def model(mode=Mode.A, **options):
    m = PathModel.of(Paths(EDGES), **options)
    for lv in "XMY":
        m = m.with_block(lv, mode, *[f"{lv.lower()}{i}" for i in (1, 2, 3)])
    return m


def ext(df):
    return Extended(M.of_rows(list(df.columns), df.to_numpy(float)), {})


def by_rows(df, mode, scheme, scaled=True, tolerance=1e-6):
    """The same iteration on rows, written plainly."""
    blocks = [[f"{lv}{i}" for i in (1, 2, 3)] for lv in "xmy"]
    z = df - df.mean()
    z = z / z.std() if scaled else z
    n = len(df)
    p = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0]])
    w = [np.ones(3) / z[b].sum(axis=1).std(ddof=0) * np.sqrt(1.0) for b in blocks]
    old = np.concatenate(w)
    for _ in range(200):
        y = np.stack([z[b].to_numpy() @ v for b, v in zip(blocks, w)], 1)
        y = y / y.std(0)
        r = np.corrcoef(y.T)
        if scheme is Scheme.CENTROID:
            e = np.sign(r) * (p + p.T)
        elif scheme is Scheme.FACTORIAL:
            e = np.cov(y.T) * (p + p.T)
        else:
            e = np.zeros((3, 3))
            for i in range(3):
                before, after = np.flatnonzero(p[i]), np.flatnonzero(p[:, i])
                if len(before):
                    e[before, i] = np.linalg.lstsq(y[:, before], y[:, i], rcond=None)[0]
                e[after, i] = r[after, i]
        inner = y @ e
        w = [z[b].to_numpy().T @ inner[:, k] / n if mode is Mode.A else np.linalg.lstsq(z[b].to_numpy(), inner[:, k], rcond=None)[0] for k, b in enumerate(blocks)]
        now = np.concatenate(w)
        if ((np.abs(now) - np.abs(old)) ** 2).sum() < tolerance:
            break
        old = now
    y = np.stack([z[b].to_numpy() @ v for b, v in zip(blocks, w)], 1)
    return np.concatenate([v / s for v, s in zip(w, y.std(0))]), y / y.std(0)


@pytest.mark.parametrize("mode", list(Mode))
@pytest.mark.parametrize("scheme", [Scheme.CENTROID, Scheme.FACTORIAL, Scheme.PATH])
@pytest.mark.parametrize("scaled", [True, False])
def test_moments_give_the_weights_of_the_rows(mode, scheme, scaled):
    df = data() * np.arange(1, 10) + 3
    s = estimate(model(mode, scaled=scaled), ext(df), scheme, 1e-13).solution
    w, _ = by_rows(df, mode, scheme, scaled, 1e-13)
    np.testing.assert_allclose(np.abs(s.weights.sum(1)), np.abs(w), rtol=1e-5)


def test_paths_are_recovered_and_effects_add_up():
    t = estimate(model(), ext(data(4000)), Scheme.PATH).tables
    paths = {(r[0], r[1]): r[2] for r in t.inner_model()}
    assert 0.35 < paths["X", "M"] < 0.62 and paths["M", "Y"] > paths["X", "Y"] > 0
    for source, target, direct, indirect, total in t.effects():
        assert total == pytest.approx(direct + indirect)
        chains = [r[3] for r in t.specific_indirect(None, source, target)]
        assert sum(chains) == pytest.approx(indirect)


def test_two_constructs_agree_under_every_scheme():
    df = data(400)
    m = PathModel.of(Paths([("X", "Y")])).with_block("X", Mode.B, "x1", "x2", "x3").with_block("Y", Mode.A, "y1", "y2", "y3")
    got = [estimate(m, ext(df[[c for c in df if c[0] in "xy"]]), s, 1e-14).tables.inner_model()[0][2] for s in Scheme]
    np.testing.assert_allclose(got, got[0], rtol=1e-6)


def test_sign_vote_turns_most_loadings_up():
    df = data()
    df["x3"] = -df["x3"]
    assert sum(np.sign(r[3]) for r in estimate(model(), ext(df)).tables.outer_model() if r[1] == "X") > 0


def test_numeric_scale_gives_the_metric_paths():
    df = data()
    a = estimate(model(), ext(df), Scheme.PATH, 1e-13).tables.inner_model()
    b = estimate(model(default_scale=Scale.NUM), ext(df), Scheme.PATH, 1e-13).tables.inner_model()
    np.testing.assert_allclose([abs(r[2]) for r in a], [abs(r[2]) for r in b], atol=1e-6)


def test_monotone_pools_violators():
    np.testing.assert_allclose(monotone(np.array([1.0, 3, 2, 4]), np.array([1.0, 1, 3, 1])), [1, 2.25, 2.25, 4])
    np.testing.assert_allclose(monotone(np.array([3.0, 2, 1]), np.ones(3)), [2, 2, 2])


def test_validity_formulas():
    df = data()
    t = estimate(model(), ext(df), Scheme.PATH).tables
    r = np.abs(df.corr().to_numpy())
    within = [r[np.ix_(k, k)][np.triu_indices(3, 1)] for k in ([0, 1, 2], [3, 4, 5], [6, 7, 8])]
    found = {(a, b): v for a, b, v in t.htmt()}
    assert found["X", "M"] == pytest.approx(r[:3, 3:6].mean() / np.sqrt(within[0].mean() * within[1].mean()))
    x = df[["x1", "x2", "x3"]]
    z = (x - x.mean()) / x.std()
    alpha = 3 / 2 * (1 - 3 / z.sum(axis=1).var())
    assert t.reliability()[0][3] == pytest.approx(alpha)
    v = {r[1]: r[2] for r in t.vif_items()}
    assert v["x1"] == pytest.approx(np.linalg.inv(x.corr().to_numpy())[0, 0])
    same = df.assign(x3=df["x1"] + df["x2"])
    assert {r[2] for r in estimate(model(), ext(same)).tables.vif_items() if r[0] == "X"} == {np.inf}
    mode_b = estimate(model(Mode.B), ext(df)).tables
    pairs = {frozenset(p[:2]) for p in mode_b.residual_pairs()}
    assert frozenset(("x1", "x2")) not in pairs and frozenset(("x1", "m1")) in pairs


def test_consistent_estimates():
    from latentspark.kernel.results import Consistent

    t = estimate(model(), ext(data(4000)), Scheme.PATH).tables
    c = Consistent(t)
    assert all(0.6 < r < 1 for r in c.rho) and (np.abs(c.phi) >= np.abs(t.score_corr) - 1e-12).all()
    true = {("X", "M"): 0.6, ("M", "Y"): 0.55}
    for s, g, b in c.paths():
        if (s, g) in true:
            ordinary = next(r[2] for r in t.inner_model() if r[:2] == (s, g))
            assert abs(b - ordinary) > 0 and b > ordinary
    assert c.fit_indices()[0] < t.fit_indices()[0]
    loads = {m: x for _, m, x in c.loadings()}
    assert abs(loads["x1"] - 0.85) < 0.06 and abs(loads["x2"] - 0.78) < 0.06


def test_spec_refuses():
    p = Paths(EDGES)
    assert p.order() == p.order() == ["X", "M", "Y"]
    with pytest.raises(ValueError):
        Paths([("a", "b"), ("b", "a")]).order()
    with pytest.raises(ValueError):
        Paths().add(["a", "b"], ["c", "d"])
    with pytest.raises(TypeError):
        PathModel.of([[0]])
    with pytest.raises(ValueError):
        PathModel.of(pd.DataFrame([[0, 1], [0, 0]], index=list("ab"), columns=list("ab")))
    m = model()
    with pytest.raises(ValueError):
        m.with_block("X", Mode.A, "m1")
    with pytest.raises(ValueError):
        m.with_block("Q", Mode.A, "q")
    with pytest.raises(ValueError):
        m.check(["x1"])
    with pytest.raises(TypeError):
        m.with_block("X", Mode.A, Indicator("x1", Scale.NUM)).metric  # noqa: B018
    with pytest.raises(ValueError):
        m.with_prefix("X", Mode.A, ["a"], "zz")


def test_moments_merge_and_subtract():
    x = np.random.default_rng(0).random((50, 3)) + 1e6
    whole, a, b = (M.of_rows("abc", v) for v in (x, x[:20], x[20:]))
    for got, want in ((a.plus(b), whole), (whole.minus(a), b)):
        assert got.n == want.n
        np.testing.assert_allclose(got.mean, want.mean)
        np.testing.assert_allclose(got.cov, want.cov, rtol=1e-6)


def test_distributions():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.073388034770, abs=1e-10)
    assert dist.t_two_sided(0.5, 3.5) == pytest.approx(0.6476, abs=2e-3)
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert dist.cramer_von_mises_from_statistic(0.46136, 1e9) == pytest.approx(0.05, abs=1e-4)


def test_group_tests():
    rng = np.random.default_rng(0)
    a, b = rng.random(40), rng.random(30)
    assert henseler_p(a, b) == pytest.approx(np.mean([y > x for x in a for y in b]))
    t, df, p = parametric_t(0.5, 0.3, 0.1, 0.1, 100, 100)
    assert (round(t, 3), df) == (1.421, 198) and 0.1 < p < 0.2
    assert welch_t(0.5, 0.3, 0.1, 0.1, 100, 100)[1] == pytest.approx(198)


def test_fit_on_spark_with_gaps_and_clashing_names(spark):
    df = data(300)
    df.loc[::17, "x1"] = np.nan
    df.loc[5, ["m1", "m2", "m3"]] = np.nan
    pdf = df.assign(id=range(300), k="text", salt=1.0, block=2.0)
    sdf = spark.createDataFrame(pdf)
    f = fit(sdf, model(), Scheme.PATH, keep=["id"])
    kept = df.drop(index=5)
    kept = kept.fillna(kept.mean())
    t = estimate(model(), ext(kept), Scheme.PATH).tables
    np.testing.assert_allclose([r.estimate for r in f.inner_model().collect()], [r[2] for r in t.inner_model()], atol=1e-9)
    scores = f.scores(["id"]).toPandas().sort_values("id")
    assert len(scores) == 299
    np.testing.assert_allclose(scores[["X", "M", "Y"]].std(ddof=0), 1, atol=1e-9)
    np.testing.assert_allclose(np.corrcoef(scores[["X", "M", "Y"]].T), t.score_corr, atol=1e-9)
    assert fit(sdf, model(), missing="listwise").data().count() == len(df.dropna())
    assert fit(sdf, model(), missing="mean").data().count() == 300
    with pytest.raises(ValueError):
        fit(sdf, model().with_block("X", Mode.A, "k"))
    with pytest.raises(Exception):  # noqa: B017
        fit(sdf.limit(0), model())


def test_means_and_moments_come_from_one_pass_over_gaps(spark):
    from latentspark.moments import grouped_moments, moments

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) + [1e7, 0, -5]
    x[rng.random(x.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(g=["u", "v"] * 200)
    df = spark.createDataFrame(pdf).repartition(7)
    m = moments(df, ["a", "b", "c"], gaps="mean")
    filled = pdf[["a", "b", "c"]].fillna(pdf[["a", "b", "c"]].mean())
    assert m.n == 400 and np.allclose(m.mean, filled.mean()) and np.allclose(m.cov, filled.cov())
    for g, got in grouped_moments(df, ["a", "b", "c"], {"g": "string"}, gaps="mean").items():
        own = pdf[pdf.g == g][["a", "b", "c"]]
        assert np.allclose(got.cov, own.fillna(own.mean()).cov())
    whole = pdf[["a", "b", "c"]].dropna()
    assert np.allclose(moments(df, ["a", "b", "c"]).cov, whole.cov())
    assert moments(df.withColumn("a", df.a * float("nan")), ["a", "b"], gaps="mean").n == 0


def test_many_tasks_are_merged_in_bounded_groups(spark):
    from latentspark.moments import FAN_IN, moments

    m = moments(spark.range(0, 3000, 1, 2000).withColumn("y", -F.col("id")), ["id", "y"])
    assert 2000 > FAN_IN and m.n == 3000 and m.mean[0] == pytest.approx(1499.5) and m.cov[0, 1] == pytest.approx(-m.cov[0, 0])


def test_more_categories_than_a_square_would_hold(spark):
    """A fit takes any number of categories, and equals the one on the dense moments of all dummies."""
    rng = np.random.default_rng(3)
    n, k = 4000, 1200
    level = rng.normal(size=n)
    study = np.argsort(rng.random(n)) % k  # every category comes
    x = pd.DataFrame({"a": np.digitize(level + rng.normal(size=n), [-1, 0, 1]), "b": level + rng.normal(size=n), "s": study * 10, "y": level + study % 7 / 3 + rng.normal(size=n), "z": level + rng.normal(size=n)})
    m = PathModel.of(Paths([("X", "Y"), ("S", "Y")]), default_scale=Scale.NUM)
    m = m.with_block("X", Mode.A, Indicator("a", Scale.ORD), "b").with_block("S", Mode.A, Indicator("s", Scale.NOM)).with_block("Y", Mode.A, "y", "z")
    f = fit(spark.createDataFrame(x.astype(float)), m, Scheme.CENTROID, 1e-9, 500)
    levels = {c: [f"{c}={i}" for i in range(x[c].nunique())] for c in ("a", "s")}
    dummies = [(x[c].to_numpy()[:, None] == np.sort(x[c].unique())).astype(float) for c in ("a", "s")]
    names = ("b", "y", "z", *levels["a"], *levels["s"])
    dense = Extended(M.of_rows(names, np.concatenate([x[["b", "y", "z"]].to_numpy(), *dummies], axis=1)), levels)
    e = estimate(m, dense, Scheme.CENTROID, 1e-9, 500)
    got, held = f.prepared.extended.moments, dense.moments
    order = [got.names.index(c) for c in names]
    np.testing.assert_allclose((got.m2 @ np.eye(len(names)))[np.ix_(order, order)], held.m2, atol=1e-8)
    np.testing.assert_allclose(got.sd[order], held.sd, atol=1e-10)
    np.testing.assert_allclose([r[2:] for r in f.tables.inner_model()], [r[2:] for r in e.tables.inner_model()], rtol=1e-7)
    s = f.scores().toPandas()
    assert abs(s["S"].std(ddof=0) - 1) < 1e-9 and abs(s["S"].mean()) < 1e-8
    with pytest.raises(ValueError, match="categories"):
        bootstrap(f, "s")
