"""Numeric scales with gaps against a plain row version of the same iteration."""

import numpy as np
import pytest

from latentspark.nonmetric import fit_with_gaps
from latentspark.model import fit
from latentspark.spec import Mode, Scale, Scheme
from tests.test_model import data, model


def by_rows(df, tolerance):
    blocks = [[f"{lv}{i}" for i in (1, 2, 3)] for lv in "xmy"]
    path = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0]])
    n = len(df)
    z = (df - df.mean()) / df.std(ddof=0)
    first = (df - df.mean()) / df.std() * np.sqrt(n / (n - 1))

    def scores(z, w):
        return np.stack([np.nansum(z[b].to_numpy() * v, 1) / (z[b].notna().to_numpy() * v**2).sum(1) for b, v in zip(blocks, w)], 1)

    y = scores(first, [np.ones(3) / np.sqrt(3)] * 3)
    for _ in range(300):
        e = np.sign(np.corrcoef(y.T)) * (path + path.T)
        inner = y @ e
        w = []
        for k, b in enumerate(blocks):
            x, has = z[b].to_numpy(), z[b].notna().to_numpy()
            w.append(np.nansum(x * inner[:, [k]], 0) / ((has * inner[:, [k]]) ** 2).sum(0))
        new = scores(z, w)
        new = (new - new.mean(0)) / new.std(0)
        change = ((np.abs(new) - np.abs(y)) ** 2).sum()
        y = new
        if change < tolerance:
            return y
    raise AssertionError("no convergence")


def test_gaps_stay_gaps(spark):
    df = data(300)
    df.iloc[::11, 0] = np.nan
    df.iloc[3::13, 4] = np.nan
    t = fit_with_gaps(spark.createDataFrame(df).repartition(3), model(default_scale=Scale.NUM), Scheme.CENTROID, 1e-9)
    y = by_rows(df, 1e-9)
    np.testing.assert_allclose(np.abs(t.score_corr), np.abs(np.corrcoef(y.T)), atol=1e-8)
    want = [df[c].corr(df[c] * 0 + y[:, k]) for k, lv in enumerate("xmy") for c in (f"{lv}1", f"{lv}2", f"{lv}3")]
    np.testing.assert_allclose(np.abs(t.loading), np.abs(want), atol=1e-8)


def test_without_gaps_it_is_the_ordinary_fit(spark):
    sdf = spark.createDataFrame(data(200))
    m = model(default_scale=Scale.NUM)
    a = fit_with_gaps(sdf, m, Scheme.PATH, 1e-12).outer_model()
    b = fit(sdf, m, Scheme.PATH, 1e-12).tables.outer_model()
    np.testing.assert_allclose([r[2:5] for r in a], [r[2:5] for r in b], atol=1e-5)


def test_refusals(spark):
    sdf = spark.createDataFrame(data(50))
    for m in (model(), model(Mode.B, default_scale=Scale.NUM), model(default_scale=Scale.ORD)):
        with pytest.raises(ValueError):
            fit_with_gaps(sdf, m)
    with pytest.raises(Exception):  # noqa: B017
        fit_with_gaps(sdf.limit(0), model(default_scale=Scale.NUM))
