"""Outer weights of a path model from moments only: the metric and the nonmetric fixpoints.

All of it is dense algebra on (columns x columns) matrices; no function here sees a row or Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from latentspark.moments import Moments
from latentspark.spec import Block, Mode, Scale, Scheme


class NoConvergence(Exception):
    """The weights did not settle within the iterations allowed."""


@dataclass
class Solution:
    """weights: indicators x constructs on treated columns (not flipped). signs: of the scores.
    treated: moments of the treated (quantified) columns. score_cov: ddof-1 covariance of the scores.
    quantified: for ORD and NOM indicators, the value given to each category."""

    lvs: list[str]
    mvs: list[str]
    weights: np.ndarray
    signs: np.ndarray
    treated: Moments
    score_cov: np.ndarray
    cross: np.ndarray  # correlations of indicators with scores, signs applied
    iterations: int
    quantified: dict[str, np.ndarray]


def inner_weights(scheme: Scheme, path: np.ndarray, corr: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """E with the inner estimate Z = Y E; path has rows as targets.

    NEWTON and PCA store the coefficients of construct j's neighbours in row j, which gives other
    inner estimates than columns would; results published for these schemes have that orientation.
    """
    linked = path + path.T
    if scheme is Scheme.CENTROID:
        return np.sign(corr) * linked
    if scheme is Scheme.FACTORIAL:
        return cov * linked
    e = np.zeros_like(corr)
    for i in range(len(path)):
        if scheme is Scheme.PATH:
            before, after = np.flatnonzero(path[i]), np.flatnonzero(path[:, i])
            if len(before):
                e[before, i] = np.linalg.lstsq(cov[np.ix_(before, before)], cov[before, i], rcond=None)[0]
            e[after, i] = corr[after, i]
            continue
        near = np.flatnonzero(linked[i])
        if not len(near):
            continue
        inside, toward = cov[np.ix_(near, near)], cov[near, i]
        if scheme is Scheme.NEWTON:
            e[i, near] = np.linalg.lstsq(inside, toward, rcond=None)[0]
        else:
            direction = np.linalg.eigh(inside)[1][:, -1] if len(near) > 1 else np.ones(1)
            e[i, near] = -direction if direction @ toward < 0 else direction
    return e


def _design(blocks: list[Block]) -> tuple[list[str], list[np.ndarray]]:
    mvs = [m for b in blocks for m in b.names]
    at, where = 0, []
    for b in blocks:
        where.append(np.arange(at, at + len(b.indicators)))
        at += len(b.indicators)
    return mvs, where


def solve_metric(path: pd.DataFrame, blocks: list[Block], m: Moments, scaled: bool, scheme: Scheme, tolerance: float, iterations: int) -> Solution:
    """The iteration of modes A and B on the covariance of the (optionally standardised) columns.

    blocks in path order. Stops when the squared changes of |weight| sum to less than ``tolerance``.
    """
    lvs = list(path.columns)
    p = path.to_numpy(dtype=float)
    mvs, where = _design(blocks)
    m = m.select(mvs)
    s = m.corr if scaled else m.cov
    n = m.n
    kappa = n / (n - 1)
    corr = np.sqrt(kappa)
    inverse = [np.linalg.pinv(s[np.ix_(w, w)]) if b.mode is Mode.B else None for b, w in zip(blocks, where)]
    w = np.zeros((len(mvs), len(lvs)))
    for k, at in enumerate(where):
        w[at, k] = corr / np.sqrt(s[np.ix_(at, at)].sum())
    old = w.sum(1)
    count = 0
    while True:
        count += 1
        c = w.T @ s @ w
        d = 1 / np.sqrt(np.diag(c))
        r = c * np.outer(d, d)
        e = inner_weights(scheme, p, r, r / kappa)
        toward = s @ (w * d) @ e  # cov of columns with Z, up to the factor below
        new = np.zeros_like(w)
        for k, (at, inv) in enumerate(zip(where, inverse)):
            new[at, k] = toward[at, k] / (kappa * corr) if inv is None else inv @ toward[at, k] / corr
        w = new
        now = w.sum(1)
        change = float(((np.abs(old) - np.abs(now)) ** 2).sum())
        old = now
        if change < tolerance:
            break
        if count > iterations or not np.isfinite(change):
            raise NoConvergence(f"no convergence after {count} iterations")
    w = w * (corr / np.sqrt(np.diag(w.T @ s @ w)))
    cov = w.T @ s @ w
    cross = (s @ w) / np.sqrt(np.outer(np.diag(s), np.diag(cov)))
    signs = np.ones(len(lvs))
    for k, at in enumerate(where):
        used = at[w[at, k] != 0]
        if np.sign(cross[used, k]).sum() < 0:
            signs[k] = -1
    treated = Moments(tuple(mvs), n, np.zeros(len(mvs)), s * (n - 1))
    return Solution(lvs, mvs, w, signs, treated, cov * np.outer(signs, signs), cross * signs, count, {})


def monotone(means: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Least squares fit of non-decreasing values (pooled adjacent violators)."""
    values, sizes, spans = [], [], []
    for v, n in zip(means, counts):
        values.append(float(v))
        sizes.append(float(n))
        spans.append(1)
        while len(values) > 1 and values[-2] > values[-1]:
            n2, v2, k2 = sizes.pop(), values.pop(), spans.pop()
            values[-1] = (values[-1] * sizes[-1] + v2 * n2) / (sizes[-1] + n2)
            sizes[-1] += n2
            spans[-1] += k2
    return np.repeat(values, spans)


@dataclass(frozen=True)
class Extended:
    """Moments of raw columns and category dummies. levels: per ORD or NOM indicator the dummy
    columns in rank order."""

    moments: Moments
    levels: dict[str, list[str]]

    def present(self) -> Extended:
        """Without the categories that these rows do not have."""
        m = self.moments
        gone = {d for ds in self.levels.values() for d in ds if m.mean[m.names.index(d)] * m.n < 0.5}
        if not gone:
            return self
        return Extended(m.select([n for n in m.names if n not in gone]), {i: [d for d in ds if d not in gone] for i, ds in self.levels.items()})


def solve_nonmetric(path: pd.DataFrame, blocks: list[Block], x: Extended, scheme: Scheme, tolerance: float, iterations: int) -> Solution:
    """The fixpoint that also re-quantifies ORD and NOM indicators, on the extended moments.

    Every quantified column and score is linear in [numeric columns | dummies], so the state is a
    coefficient vector per indicator and all products come from the Gram matrix. The stop criterion
    sums squared changes of scores with their overall signs aligned, which is never less than the sum
    over |score| changes by row.
    """
    lvs = list(path.columns)
    p = path.to_numpy(dtype=float)
    mvs, where = _design(blocks)
    g = x.moments
    n = g.n
    index = {c: i for i, c in enumerate(g.names)}
    dummies = {name: np.array([index[d] for d in ds], dtype=int) for name, ds in x.levels.items()}
    pop = g.m2 / n  # population covariance of the extended columns
    indicators = [i for b in blocks for i in b.indicators]
    raw_only = all(i.scale is Scale.RAW for i in indicators)

    def standard(v: np.ndarray) -> np.ndarray:
        sd = np.sqrt(max(v @ pop @ v, 0.0))
        return v / sd if sd > 0 else np.zeros_like(v)

    coefs = np.zeros((len(g.names), len(mvs)))
    for j, i in enumerate(indicators):
        if i.scale in (Scale.ORD, Scale.NOM):
            ranks = np.zeros(len(g.names))
            ranks[dummies[i.name]] = np.arange(1, len(x.levels[i.name]) + 1)
            coefs[:, j] = ranks  # the dense rank, as it is
        else:
            unit = np.zeros(len(g.names))
            unit[index[i.name]] = 1
            coefs[:, j] = unit if raw_only else standard(unit)
    start = coefs.copy()
    mean = g.mean

    def mixed(v: np.ndarray) -> float:
        return float(mean @ v)

    scores = np.zeros((len(g.names), len(lvs)))  # coefficients of the scores
    offset = np.zeros(len(lvs))  # constants that centre them; ranks enter uncentred at first
    for k, at in enumerate(where):
        scores[:, k] = coefs[:, at].sum(1) / np.sqrt(len(at))
        plain = [j for j in at if indicators[j].scale not in (Scale.ORD, Scale.NOM)]
        offset[k] = -mixed(coefs[:, plain].sum(1)) / np.sqrt(len(at))
    weights = [np.zeros(0)] * len(lvs)
    quantified: dict[str, np.ndarray] = {}
    count = 0
    while True:
        count += 1
        before, before_offset = scores.copy(), offset.copy()
        c = scores.T @ pop @ scores
        sd = np.sqrt(np.diag(c))
        e = inner_weights(scheme, p, c / np.outer(sd, sd), c * n / (n - 1))
        z_all, z_offset = scores @ e, offset @ e
        for k, (b, at) in enumerate(zip(blocks, where)):
            z, z0 = z_all[:, k], float(z_offset[k])
            along = pop @ z
            betas = None
            for j in at:
                i = indicators[j]
                if i.scale is Scale.NUM:
                    coefs[:, j] = standard(start[:, j])
                    continue
                if i.scale is Scale.RAW:
                    continue
                part, part0, toward = z, z0, along
                if b.mode is Mode.B and len(at) > 1:
                    if betas is None:
                        q = coefs[:, at]
                        betas = np.linalg.lstsq(q.T @ pop @ q, q.T @ pop @ z, rcond=None)[0]
                    own = int(j - at[0])
                    others = coefs[:, at].copy()
                    others[:, own] = 0
                    part = (z - others @ betas) / betas[own]
                    centred = float(mean @ others @ betas)  # quantified columns have mean zero
                    part0 = (z0 + centred) / betas[own]
                    toward = pop @ part
                cols = dummies[i.name]
                counts = mean[cols] * n
                means = toward[cols] / mean[cols] + float(mean @ part) + part0
                if i.scale is Scale.NOM:
                    values = means
                else:
                    up = monotone(means, counts)
                    down = -monotone(-means, counts)
                    share = counts / n
                    spread = [share @ v**2 - (share @ v) ** 2 for v in (up, down)]
                    values = -down if spread[0] < spread[1] else up
                quantified[i.name] = values
                v = np.zeros(len(g.names))
                v[cols] = values
                coefs[:, j] = standard(v)
            q = coefs[:, at]
            # second moments about the columns' own means: quantified columns are centred
            cross = q.T @ pop @ z
            if b.mode is Mode.A:
                size = float(z @ pop @ z) + (mixed(z) + z0) ** 2
                weights[k] = cross / size
            else:
                weights[k] = np.linalg.lstsq(q.T @ pop @ q, cross, rcond=None)[0]
            y = q @ weights[k]
            scores[:, k] = standard(y)
            offset[k] = -mixed(scores[:, k])
        change = 0.0
        for k in range(len(lvs)):
            side = 1.0 if before[:, k] @ pop @ scores[:, k] >= 0 else -1.0
            d = before[:, k] - side * scores[:, k]
            shift = mixed(d) + before_offset[k] - side * offset[k]
            change += n * (float(d @ pop @ d) + shift**2)
        if change < tolerance:
            break
        if count > iterations or not np.isfinite(change):
            raise NoConvergence(f"no convergence after {count} iterations")
    s = coefs.T @ pop @ coefs * n / (n - 1)  # ddof-1 covariance of the quantified columns
    w = np.zeros((len(mvs), len(lvs)))
    for k, at in enumerate(where):
        w[at, k] = weights[k]
    w = w * np.sqrt(n / (n - 1)) / np.sqrt(np.diag(w.T @ s @ w))
    cov = scores.T @ pop @ scores * n / (n - 1)
    cross = (coefs.T @ pop @ scores) / np.sqrt(np.outer(np.diag(coefs.T @ pop @ coefs), np.diag(scores.T @ pop @ scores)))
    treated = Moments(tuple(mvs), n, np.zeros(len(mvs)), s * (n - 1))
    values = {k: v for k, v in quantified.items()}
    return Solution(lvs, mvs, w, np.ones(len(lvs)), treated, cov, cross, count, values)
