"""Latent classes of the structural model: finite mixture regression by expectation-maximisation.

A class's regressions need only its weighted moments, so a pass over the scores yields, for all
restarts at once, the responsibilities under the current classes and the weighted moments that give
the next ones. What is carried from pass to pass is classes x scores^2 numbers per restart.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.model import FittedModel
from latentspark.moments import task_group
from latentspark.resample import uniforms
from latentspark.sources import materialise

# Least share and variance of a class, least membership in the entropy.
SHARE_FLOOR, VARIANCE_FLOOR, CLIP = 1e-12, 1e-10, 1e-12


@dataclass
class Classes:
    """One restart's mixture: shares, and per class and equation coefficients (intercept first) and
    the variance of the rest."""

    share: np.ndarray
    coefficients: list[list[np.ndarray]]
    variance: np.ndarray


def _log_density(x: np.ndarray, equations, c: Classes) -> np.ndarray:
    out = np.tile(np.log(c.share), (len(x), 1))
    for k in range(len(c.share)):
        for e, (y, on) in enumerate(equations):
            b, v = c.coefficients[k][e], c.variance[k, e]
            out[:, k] -= 0.5 * (math.log(2 * math.pi * v) + (x[:, y] - b[0] - x[:, on] @ b[1:]) ** 2 / v)
    return out


def _from_sums(sums: np.ndarray, equations, n: float) -> Classes:
    """M-step: from per-class sums of [1, x]'[1, x] weighted by responsibility."""
    classes = len(sums)
    share = np.maximum(sums[:, 0, 0] / n, SHARE_FLOOR)
    coefficients, variance = [], np.zeros((classes, len(equations)))
    for k in range(classes):
        own = []
        for e, (y, on) in enumerate(equations):
            at = np.concatenate([[0], np.asarray(on) + 1])
            a, b = sums[k][np.ix_(at, at)], sums[k][at, y + 1]
            beta = np.linalg.lstsq(a, b, rcond=None)[0]
            rest = sums[k][y + 1, y + 1] - 2 * beta @ b + beta @ a @ beta
            variance[k, e] = max(rest / max(sums[k][0, 0], SHARE_FLOOR), VARIANCE_FLOOR)
            own.append(beta)
        coefficients.append(own)
    return Classes(share / share.sum(), coefficients, variance)


class Fimix:
    """Latent-class segmentation of a fit made with ``keep=[row_id]``; starts come from hashes of the
    row ids, so partitioning does not matter. The best of ``restarts`` by likelihood is kept;
    ``converged`` tells whether it met the tolerance within ``max_iter`` steps, ``iterations`` after
    how many it stopped, ``restarts_converged`` how many of all restarts met it."""

    def __init__(self, fit: FittedModel, row_id: str, classes: int, max_iter: int = 500, tolerance: float = 1e-6, restarts: int = 5, seed: int = 42):
        if classes < 2:
            raise ValueError("at least two classes")
        if max_iter < 10 or tolerance <= 0 or restarts < 1:
            raise ValueError("at least ten iterations, one restart and a tolerance above 0")
        self.fit, self.row_id, self.classes = fit, row_id, classes
        self.lvs = fit.model.lvs
        self.equations = [(self.lvs.index(v), [self.lvs.index(s) for s in self.lvs if fit.model.path.loc[v, s]]) for v in fit.model.endogenous()]
        if not self.equations:
            raise ValueError("the model has no endogenous construct")
        self.scores = materialise(fit.scores([row_id]).withColumn("_h", F.xxhash64(F.col(f"`{row_id}`"))), "scores")
        self.n = fit.prepared.moments.n
        states: list[Classes | None] = [None] * restarts
        likelihood, done = np.full(restarts, -np.inf), np.zeros(restarts, dtype=bool)
        entropy = np.zeros(restarts)
        met, steps = np.zeros(restarts, dtype=bool), np.zeros(restarts, dtype=int)
        for step in range(max_iter + 1):
            sums, ll, ent = self._pass(states, done, seed)
            for r in range(restarts):
                if done[r]:
                    continue
                if states[r] is not None:
                    entropy[r] = ent[r]
                    met[r], steps[r] = abs(ll[r] - likelihood[r]) < tolerance, step
                    done[r] = met[r] or step == max_iter
                    likelihood[r] = ll[r]
                if not done[r]:
                    states[r] = _from_sums(sums[r], self.equations, self.n)
            if done.all():
                break
        best = int(np.argmax(likelihood))
        self.state, self.log_likelihood, self.entropy = states[best], float(likelihood[best]), float(entropy[best])
        self.converged, self.iterations, self.restarts_converged = bool(met[best]), int(steps[best]), int(met.sum())

    def _pass(self, states, done, seed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lvs, equations, classes = self.lvs, self.equations, self.classes
        p = len(lvs) + 1
        sent = self.fit.spark.sparkContext.broadcast(cloudpickle.dumps((states, done)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            states, done = pickle.loads(sent.value)
            sums = np.zeros((len(states), classes, p, p))
            ll, ent = np.zeros(len(states)), np.zeros(len(states))
            for b in batches:
                x = b[lvs].to_numpy(dtype=float)
                ids = b["_h"].to_numpy(dtype=np.int64)
                one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                for r, state in enumerate(states):
                    if done[r]:
                        continue
                    if state is None:  # uniform on the simplex
                        post = -np.log1p(-uniforms(ids, np.arange(classes), seed + r)).T + 1e-300
                        post /= post.sum(1, keepdims=True)
                    else:
                        lp = _log_density(x, equations, state)
                        top = lp.max(1, keepdims=True)
                        norm = top[:, 0] + np.log(np.exp(lp - top).sum(1))
                        post = np.exp(lp - norm[:, None])
                        ll[r] += norm.sum()
                        clipped = np.clip(post, CLIP, 1)
                        ent[r] -= (clipped * np.log(clipped)).sum()
                    for k in range(classes):
                        sums[r, k] += (one * post[:, k : k + 1]).T @ one
            flat = np.concatenate([sums.ravel(), ll, ent])
            yield pd.DataFrame({"part": [task_group()], "data": [flat.tobytes()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(d) for d in pdf["data"]], axis=0)
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [total.tobytes()]})

        schema = "part int, data binary"
        merged = self.scores.select("_h", *[F.col(f"`{v}`") for v in lvs]).mapInPandas(run, schema).groupBy("part").applyInPandas(add, schema)
        flat = np.sum([np.frombuffer(r["data"]) for r in sorted(merged.collect())], axis=0)  # tasks / FAN_IN rows
        sent.destroy()
        r = len(states)
        cut = r * classes * p * p
        return flat[:cut].reshape(r, classes, p, p), flat[cut : cut + r], flat[cut + r :]

    def memberships(self) -> DataFrame:
        """(row_id, class_1 .. class_K, class, converged): posterior shares, the most likely class, and
        whether the restart behind them converged."""
        lvs, equations, state, key, classes, converged = self.lvs, self.equations, self.state, self.row_id, self.classes, self.converged
        kind = self.scores.schema[key].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                lp = _log_density(b[lvs].to_numpy(dtype=float), equations, state)
                post = np.exp(lp - lp.max(1, keepdims=True))
                post /= post.sum(1, keepdims=True)
                out = pd.DataFrame(post, columns=[f"class_{k + 1}" for k in range(classes)])
                out.insert(0, key, b[key].to_numpy())
                out["class"] = post.argmax(1).astype(np.int32) + 1
                out["converged"] = converged
                yield out

        schema = ", ".join([f"`{key}` {kind}", *[f"class_{k + 1} double" for k in range(classes)], "class int", "converged boolean"])
        return self.scores.mapInPandas(run, schema)

    def class_sizes(self) -> DataFrame:
        return self.fit.spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(self.state.share)], "class int, share double")

    def class_paths(self) -> DataFrame:
        rows = []
        for k in range(self.classes):
            for (y, on), b in zip(self.equations, self.state.coefficients[k]):
                rows += [(k + 1, s, self.lvs[y], float(v)) for s, v in zip(["(intercept)", *[self.lvs[j] for j in on]], b)]
        return self.fit.spark.createDataFrame(rows, "class int, source string, target string, estimate double")

    def fit_criteria(self) -> DataFrame:
        k, ll, n = self.classes, self.log_likelihood, self.n
        m = k * sum(len(on) + 2 for _, on in self.equations) + k - 1
        en = 1 - self.entropy / (n * math.log(k)) if k > 1 else float("nan")
        row = (ll, m, -2 * ll + 2 * m, -2 * ll + 3 * m, -2 * ll + 4 * m, -2 * ll + math.log(n) * m, -2 * ll + (math.log(n) + 1) * m, -2 * ll + 5 * m * math.log(n), en, self.converged, self.iterations, self.restarts_converged)
        return self.fit.spark.createDataFrame([row], "log_lik double, n_params int, aic double, aic3 double, aic4 double, bic double, caic double, mdl5 double, en double, converged boolean, iterations int, restarts_converged int")
