"""Mode A blocks of numeric scale with gaps, estimated without filling them.

A row's score is its weighted answers over the squared weights of what it answered, so moments do not
suffice. One pass per iteration does: with the current weights each row's raw scores follow at once,
and from their sums with the answers, squared and crossed by which answers exist, the next weights are
found by algebra. What a task sends is columns x constructs^2 numbers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.kernel.results import Tables
from latentspark.kernel.weights import NoConvergence, Solution, inner_weights
from latentspark.model import numbers
from latentspark.moments import Moments, task_group
from latentspark.sources import materialise
from latentspark.spec import Mode, PathModel, Scale, Scheme


def _sum_up(df: DataFrame, columns: Sequence[str], reduce_rows, payload) -> np.ndarray:
    """Elementwise sum over all batches of ``reduce_rows(x, payload)``, a flat vector."""
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps((reduce_rows, payload)))
    cols = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, given = pickle.loads(sent.value)
        total = None
        for b in batches:
            v = f(b[cols].to_numpy(dtype=float), given)
            total = v if total is None else total + v
        if total is not None:
            yield pd.DataFrame({"part": [task_group()], "data": [total.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(d) for d in pdf["data"]], axis=0)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [total.tobytes()]})

    parts = df.select(*[F.col(f"`{c}`") for c in cols]).mapInPandas(run, "part int, data binary").groupBy("part").applyInPandas(add, "part int, data binary")
    got = [np.frombuffer(r["data"]) for r in sorted(parts.collect())]  # tasks / FAN_IN rows
    if not got:
        raise ValueError("no rows")
    return np.sum(got, axis=0)


def _raw_scores(x: np.ndarray, mean, sd, weights, member) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(standardised answers with 0 for gaps, which exist, raw scores)."""
    has = np.isfinite(x)
    z = np.where(has, (np.nan_to_num(x) - mean) / sd, 0.0)
    w = weights[:, None] * member
    # blocks without any gap divide by one: that only changes the scale, which is standardised away
    below = has.astype(float) @ w**2
    return z, has.astype(float), np.divide(z @ w, below, out=np.zeros_like(below), where=below > 0)


def fit_with_gaps(df: DataFrame, model: PathModel, scheme: Scheme = Scheme.CENTROID, tolerance: float = 1e-6, iterations: int = 100) -> Tables:
    """Tables of a model whose indicators are all on the NUM scale in mode A, with gaps left as gaps.

    Rows in which some construct has no answer at all are dropped. Indicator correlations are pairwise.
    """
    model.check(df.columns)
    if any(i.scale is not Scale.NUM for i in model.indicators) or any(b.mode is not Mode.A for b in model.blocks.values()):
        raise ValueError("gaps are only supported for numeric scales in mode A")
    blocks = [model.blocks[lv] for lv in model.lvs]
    mvs = [m for b in blocks for m in b.names]
    member = np.array([[m in b.names for b in blocks] for m in mvs], dtype=float)
    rows = numbers(df, mvs)
    for b in blocks:
        rows = rows.filter(F.coalesce(*[F.col(f"`{n}`") for n in b.names]).isNotNull())
    rows = materialise(rows, "gaps")
    p, k = len(mvs), len(blocks)
    path = model.path.to_numpy(dtype=float)
    stats = rows.agg(*[f(F.col(f"`{m}`")).alias(f"{a}{i}") for i, m in enumerate(mvs) for a, f in (("m", F.avg), ("s", F.stddev_pop), ("c", F.count))], F.count(F.lit(1)).alias("n")).first()
    n = float(stats["n"])
    if n < 2:
        raise ValueError("too few rows")
    mean = np.array([stats[f"m{i}"] for i in range(p)], dtype=float)
    sd = np.array([stats[f"s{i}"] for i in range(p)], dtype=float)
    answered = np.array([stats[f"c{i}"] for i in range(p)], dtype=float)
    # the first scores standardise by all rows, the iterations by the rows that have an answer
    first_sd = sd * np.sqrt(answered / (answered - 1) * (n - 1) / n)

    def passes(x: np.ndarray, given) -> np.ndarray:
        mean, sd, member, now, before = given
        z, has, y = _raw_scores(x, mean, sd, now, member)
        out = [y.sum(0), (y.T @ y).ravel(), z.sum(0), has.sum(0), (z.T @ y).ravel(), (has.T @ y).ravel()]
        out.append(np.einsum("ij,ik,il->jkl", has, y, y, optimize=True).ravel())
        if before is not None:  # change between the scores of the last two iterations
            _, _, a = _raw_scores(x, mean, sd, before[0], member)
            _, _, b = _raw_scores(x, mean, sd, before[1], member)
            d = np.abs((a - before[2]) / before[3]) - np.abs((b - before[4]) / before[5])
            out.append(np.array([(d**2).sum()]))
        else:
            out.append(np.array([np.inf]))
        return np.concatenate(out)

    weights = (member / np.sqrt(member.sum(0))).sum(1)
    first_raw = True
    older = None
    centres: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for count in range(1, max(iterations, 100) + 3):
        flat = _sum_up(rows, mvs, passes, (mean, first_sd if first_raw else sd, member, weights, older))
        cuts = np.cumsum([k, k * k, p, p, p * k, p * k, p * k * k])
        sy, syy, sz, sh, zy, hy, hyy, change = np.split(flat, cuts)
        syy, zy, hy, hyy = syy.reshape(k, k), zy.reshape(p, k), hy.reshape(p, k), hyy.reshape(p, k, k)
        if change[0] < tolerance:  # of the scores that the last two kept weights give
            weights, centre, scale = centres[-1]
            break
        # scores as they enter the iteration: raw at the start, standardised afterwards
        centre = np.zeros(k) if first_raw else sy / n
        scale = np.ones(k) if first_raw else np.sqrt(np.diag(syy) / n - (sy / n) ** 2)
        centres.append((weights, centre, scale))
        c = (syy - np.outer(centre, sy) - np.outer(sy, centre) + n * np.outer(centre, centre)) / np.outer(scale, scale)
        m = (sy - n * centre) / scale
        cov = (c - np.outer(m, m) / n) / (n - 1)
        dev = np.sqrt(np.diag(cov))
        e = inner_weights(scheme, path, cov / np.outer(dev, dev), cov)
        za = (zy - sz[:, None] * centre) / scale
        ha = (hyy - np.einsum("jk,l->jkl", hy, centre) - np.einsum("jl,k->jkl", hy, centre) + np.einsum("j,k,l->jkl", sh, centre, centre)) / np.einsum("k,l->kl", scale, scale)
        own = member.argmax(1)
        top = np.einsum("jk,kj->j", za, e[:, own])
        bottom = np.einsum("kj,jkl,lj->j", e[:, own], ha, e[:, own])
        weights = top / bottom
        if len(centres) >= 2:
            (w1, c1, s1), (w2, c2, s2) = centres[-2:]
            older = (w1, w2, c1, s1, c2, s2)
        first_raw = False
        if not np.isfinite(weights).all():
            raise NoConvergence("weights are not finite")
    else:
        raise NoConvergence(f"no convergence after {count} iterations")

    def pairs(x: np.ndarray, given) -> np.ndarray:
        mean, sd, member, w, centre, scale = given
        z, has, y = _raw_scores(x, mean, sd, w, member)
        y = (y - centre) / scale
        return np.concatenate([(has.T @ has).ravel(), (z.T @ has).ravel(), ((z**2).T @ has).ravel(), (z.T @ z).ravel(), (z.T @ y).ravel(), (has.T @ y).ravel(), (has.T @ y**2).ravel(), (y.T @ y).ravel()])

    flat = _sum_up(rows, mvs, pairs, (mean, sd, member, weights, centre, scale))
    nn, zh, z2h, zz, zy, hy, hyy, yy = np.split(flat, np.cumsum([p * p, p * p, p * p, p * p, p * k, p * k, p * k]))
    nn, zh, z2h, zz = (v.reshape(p, p) for v in (nn, zh, z2h, zz))
    zy, hy, hyy, yy = zy.reshape(p, k), hy.reshape(p, k), hyy.reshape(p, k), yy.reshape(k, k)
    corr = (zz - zh * zh.T / nn) / np.sqrt((z2h - zh**2 / nn) * (z2h.T - zh.T**2 / nn))
    sh, sz = np.diag(nn), np.diag(zh)
    cross = (zy - sz[:, None] * hy / sh[:, None]) / np.sqrt((np.diag(z2h) - sz**2 / sh)[:, None] * (hyy - hy**2 / sh[:, None]))
    w = weights[:, None] * member
    w = w / np.sqrt(np.diag(w.T @ corr @ w))
    solution = Solution(model.lvs, mvs, w, np.ones(k), Moments(tuple(mvs), n, np.zeros(p), corr * (n - 1)), yy / (n - 1), cross, count, {})
    return Tables(solution, blocks, model.path.to_numpy())
