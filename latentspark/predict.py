"""Out-of-sample prediction (k folds) and blindfolding, from fold moments.

Folds are values of a key, so one aggregation gives all folds' moments; training moments are the total
minus the fold. Predictions of every indicator are linear in the indicators, hence squared errors are
quadratic forms of the fold's moments; only absolute and percentage errors take a pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.kernel.weights import Extended, NoConvergence
from latentspark.model import FittedModel, estimate
from latentspark.moments import Moments, grouped_moments
from latentspark.spec import PathModel

ZERO, TIE = 1e-12, 1e-12
PREDICTORS = ("direct", "earliest_antecedents")


def _endogenous(model: PathModel) -> list[tuple[str, str]]:
    return [(lv, mv) for lv in model.endogenous() for mv in model.blocks[lv].names]


def _ancestors(model: PathModel, lv: str) -> list[str]:
    """The exogenous constructs from which paths lead to ``lv``."""
    seen, todo = set(), [lv]
    while todo:
        v = todo.pop()
        before = [s for s in model.lvs if model.path.loc[v, s]]
        todo += [s for s in before if s not in seen]
        seen.update(before)
    return [v for v in model.lvs if v in seen and not model.path.loc[v].any()]


def linear_predictions(model: PathModel, train: Moments, scheme, tolerance: float, lm: str, own_scores: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(PLS, LM, means): coefficients (1 + columns) x endogenous indicators for each of the first two.

    Exogenous scores standardise the indicators by the training rows; endogenous scores follow from
    their predecessors' by the paths, or (``own_scores``, for errors within the sample) are those of the
    fit itself; an indicator is its mean + loading x standard deviation x score.
    """
    e = estimate(model, Extended(train, {}), scheme, tolerance)
    t, s = e.tables, e.solution
    names = list(train.names)
    sd0 = np.sqrt(np.diag(train.m2) / train.n)
    lvs = s.lvs
    score = np.zeros((1 + len(names), len(lvs)))
    if own_scores:
        turn = s.weights * s.signs * e.input_scale[:, None]
        for j, mv in enumerate(s.mvs):
            score[1 + names.index(mv)] = turn[j]
        score[0] = -train.mean @ score[1:]
    for k, lv in enumerate(lvs if not own_scores else ()):  # path order is topological
        if not model.path.loc[lv].any():
            for mv in model.blocks[lv].names:
                j, w = names.index(mv), s.weights[s.mvs.index(mv), k]
                if sd0[j] > 0:
                    w = w if model.scaled or not model.metric else w * sd0[j]
                    score[1 + j, k] += w / sd0[j]
                    score[0, k] -= w * train.mean[j] / sd0[j]
        else:
            score[:, k] = score @ t.inner.paths[k]
    targets = _endogenous(model)
    pls, linear, means = np.zeros((1 + len(names), len(targets))), np.zeros((1 + len(names), len(targets))), np.zeros(len(targets))
    cov = train.cov
    for c, (lv, mv) in enumerate(targets):
        j = names.index(mv)
        means[c] = train.mean[j]
        pls[:, c] = score[:, lvs.index(lv)] * sd0[j] * t.loading[s.mvs.index(mv)]
        pls[0, c] += train.mean[j]
        sources = _ancestors(model, lv) if lm == "earliest_antecedents" else [p for p in lvs if model.path.loc[lv, p]]
        x = [names.index(m) for p in sources for m in model.blocks[p].names]
        linear[0, c] = train.mean[j]
        if x and train.n > len(x) + 1:
            b = np.linalg.lstsq(cov[np.ix_(x, x)], cov[x, j], rcond=None)[0]
            linear[1 + np.array(x), c] = b
            linear[0, c] -= b @ train.mean[x]
    return pls, linear, means


def squared_error(m: Moments, j: int, coefficients: np.ndarray) -> float:
    """Sum over the rows behind ``m`` of (column j - prediction) squared."""
    d = -coefficients[1:].copy()
    d[j] += 1
    rest = m.mean @ d - coefficients[0]
    return float(d @ m.m2 @ d + m.n * rest**2)


def predict(fit: FittedModel, row_id: str, k: int = 10, repeats: int = 1, seed: int = 42, lm: str = "direct") -> tuple[DataFrame, DataFrame]:
    """(metrics, summary) of a fit made with ``keep=[row_id]``.

    A row's fold is a hash of seed, repeat and id, the same however the data are partitioned. A fold
    whose training rows cannot be fitted is left out and counted in ``skipped``. Squared errors are
    quadratic forms of the folds' moments; absolute and percentage errors take a pass over the rows.
    Rows with |y| below 1e-12 do not count for percentage errors.
    """
    if k < 2 or repeats < 1:
        raise ValueError("at least 2 folds and 1 repeat")
    if lm not in PREDICTORS:
        raise ValueError(f"lm must be one of {PREDICTORS}")
    if fit.prepared.moments.n < k:
        raise ValueError("fewer rows than folds")
    if fit.prepared.extended.levels:
        raise ValueError("prediction needs numeric indicators")
    model, total = fit.model, fit.prepared.moments
    names, targets = list(total.names), _endogenous(fit.model)
    plans: dict[str, tuple] = {}
    skipped = 0
    rows = fit.prepared.data
    long = None
    for r in range(repeats):
        fold = F.concat(F.lit(f"{r}:"), F.pmod(F.xxhash64(F.lit(seed + r), F.col(f"`{row_id}`")), F.lit(k)).cast("string"))
        one = rows.select(fold.alias("_fold"), *[F.col(f"`{n}`") for n in names])
        long = one if long is None else long.unionByName(one)
    at = [names.index(mv) for _, mv in targets]
    n_of, squares = {"out": 0.0, "in": total.n}, {"out": np.zeros((3, len(targets))), "in": np.zeros((3, len(targets)))}

    def add_squares(where: str, m: Moments, plan: tuple) -> None:
        for c, j in enumerate(at):
            for i in (0, 1):
                squares[where][i, c] += squared_error(m, j, plan[i][:, c])
            squares[where][2, c] += m.m2[j, j] + m.n * (m.mean[j] - plan[2][c]) ** 2

    for f, m in sorted(grouped_moments(long, names, {"_fold": "string"}).items()):
        try:
            plans[f] = linear_predictions(model, total.minus(m), fit.scheme, fit.tolerance, lm)
        except (NoConvergence, np.linalg.LinAlgError):
            skipped += 1
            continue
        n_of["out"] += m.n
        add_squares("out", m, plans[f])
    plans["in"] = linear_predictions(model, total, fit.scheme, fit.tolerance, lm, own_scores=True)
    add_squares("in", total, plans["in"])

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # kinds: absolutes and percentages of PLS, then of LM, rows that count for percentages
        sums = {w: np.zeros((5, len(targets))) for w in ("out", "in")}
        for b in batches:
            for f, part in b.groupby("_fold"):
                x = part[names].to_numpy(dtype=float)
                y = x[:, at]
                far = np.abs(y) > ZERO
                for where, key in (("out", f), ("in", "in")):
                    if key not in plans or (where == "in" and not f.startswith("0:")):
                        continue
                    for i, p in enumerate(plans[key][:2]):
                        d = np.abs(y - (p[0] + x @ p[1:]))
                        sums[where][2 * i] += d.sum(0)
                        sums[where][2 * i + 1] += np.where(far, d / np.where(far, np.abs(y), 1), 0).sum(0)
                    sums[where][4] += far.sum(0)
        out = [(w, c, kind, float(v[kind, c])) for w, v in sums.items() for c in range(len(targets)) for kind in range(5)]
        yield pd.DataFrame(out, columns=["place", "target", "kind", "v"])

    sums = long.mapInPandas(errors, "place string, target int, kind int, v double").groupBy("place", "target", "kind").agg(F.sum("v").alias("v"))
    v = {(r["place"], r["target"], r["kind"]): r["v"] for r in sums.collect()}  # 10 numbers per indicator
    metrics, verdicts = [], []
    for c, (lv, mv) in enumerate(targets):
        row: list = [lv, mv]
        for w in ("out", "in"):
            n, (of_pls, of_lm, about_mean) = max(n_of[w], 1.0), squares[w][:, c]
            far = v.get((w, c, 4), 0.0)
            three = []
            for i, square in enumerate((of_pls, of_lm)):
                ratio = v.get((w, c, 2 * i + 1), 0.0) / far if far else float("nan")
                three.append([float(np.sqrt(max(square, 0.0) / n)), v.get((w, c, 2 * i), float("nan")) / n, ratio] if n_of[w] else [float("nan")] * 3)
            if w == "out":
                row += [*three[0], float(1 - of_pls / about_mean) if about_mean > 0 else float("nan"), *three[1]]
            else:
                row += [*three[0], *three[1]]
        metrics.append(tuple(row))
        d = row[2] - row[6]
        verdicts.append((lv, mv, "tie" if abs(d) <= TIE else "better" if d < 0 else "worse"))
    better = sum(x[2] == "better" for x in verdicts)
    power = "high" if better == len(verdicts) else "medium" if 2 * better >= len(verdicts) else "low" if better else "none"
    columns = "rmse_pls mae_pls mape_pls q2_predict rmse_lm mae_lm mape_lm rmse_pls_in mae_pls_in mape_pls_in rmse_lm_in mae_lm_in mape_lm_in"
    spark = fit.spark
    out = spark.createDataFrame(metrics, "lv string, indicator string, " + ", ".join(f"{x} double" for x in columns.split()))
    says = spark.createDataFrame([(*x, power, skipped) for x in verdicts], "lv string, indicator string, pls_vs_lm string, predictive_power string, skipped int")
    return out, says


def q_squared(fit: FittedModel, row_id: str, distance: int = 7) -> DataFrame:
    """(lv, q_squared, skipped) by blindfolding: rows with ``row_id`` modulo ``distance`` equal to d lose the
    target block, which takes the mean of the others; no pass beyond the fold moments is needed.

    A fold that cannot be fitted is left out and counted in ``skipped``. ``row_id`` must be a whole
    number, so that the omitted rows do not depend on physical order.
    """
    if distance < 2:
        raise ValueError("the omission distance is at least 2")
    model, total = fit.model, fit.prepared.moments
    names = list(total.names)
    rows = fit.prepared.data.select(F.pmod(F.col(f"`{row_id}`"), F.lit(distance)).cast("string").alias("_d"), *[F.col(f"`{n}`") for n in names])
    folds = grouped_moments(rows, names, {"_d": "string"})
    out = []
    for lv in model.endogenous():
        block = [names.index(m) for m in model.blocks[lv].names]
        sse = sso = 0.0
        skipped = 0
        for fold in folds.values():
            rest = total.minus(fold)
            if not rest.n or not fold.n:
                skipped += 1
                continue
            mean, m2 = fold.mean.copy(), fold.m2.copy()
            mean[block] = rest.mean[block]
            m2[block, :] = 0
            m2[:, block] = 0
            filled = rest.plus(Moments(total.names, fold.n, mean, m2))
            try:
                e = estimate(model, Extended(filled, {}), fit.scheme, fit.tolerance)
            except (NoConvergence, np.linalg.LinAlgError):
                skipped += 1
                continue
            s, t = e.solution, e.tables
            k = s.lvs.index(lv)
            beta = t.inner.paths[k]
            slope = np.zeros(len(names))
            at = [names.index(m) for m in s.mvs]
            turn = s.weights * s.signs * e.input_scale[:, None]
            slope[at] = turn @ beta
            level = -filled.mean @ slope
            for j in block:
                loading = t.loading[s.mvs.index(names[j])]
                sd0 = np.sqrt(rest.m2[j, j] / rest.n)
                if sd0 == 0:
                    continue
                c = np.concatenate([[rest.mean[j] + loading * sd0 * level], loading * sd0 * slope])
                sse += squared_error(fold, j, c)
                sso += float(fold.m2[j, j] + fold.n * (fold.mean[j] - rest.mean[j]) ** 2)
        out.append((lv, 1 - sse / sso if sso > 0 else float("nan"), skipped))
    return fit.spark.createDataFrame(out, "lv string, q_squared double, skipped int")
