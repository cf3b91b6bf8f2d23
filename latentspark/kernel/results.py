"""Result tables of a fit, as plain rows computed from moments. The fixed column lists are in SCHEMAS."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from latentspark.kernel.dist import t_two_sided
from latentspark.kernel.weights import Solution
from latentspark.spec import Block, Mode

NEAR_ONE = 1 - 1e-12
NAN, INF = float("nan"), float("inf")

SCHEMAS = {
    "outer_model": "name string, block string, weight double, loading double, communality double, redundancy double",
    "crossloadings": "name string, block string, lv string, loading double",
    "inner_model": "source string, target string, estimate double, std_error double, t double, p_value double",
    "path_coefficients": "target string, source string, estimate double",
    "effects": "source string, target string, direct double, indirect double, total double",
    "inner_summary": "lv string, type string, r_squared double, r_squared_adj double, block_communality double, mean_redundancy double, ave double, bic double",
    "reliability": "lv string, mode string, mvs int, cronbach_alpha double, dillon_goldstein_rho double, eig_1st double, eig_2nd double",
    "htmt": "lv_a string, lv_b string, htmt double",
    "htmt2": "lv_a string, lv_b string, htmt2 double",
    "fornell_larcker": "lv string, sqrt_ave double, max_abs_corr double, passes boolean, note string",
    "f_squared": "source string, target string, r_squared_full double, r_squared_reduced double, f_squared double, effect_size string",
    "vif_items": "lv string, indicator string, vif double",
    "vif_inner": "lv string, predictor string, vif double",
    "fit_indices": "srmr double, d_uls double, goodness_of_fit double",
    "residuals": "mv_a string, mv_b string, residual double",
    "specific_indirect": "source string, target string, via array<string>, estimate double",
    "plsc_summary": "lv string, rho_a double, ave double, rho_c double, r_squared double, r_squared_adj double, bic double",
    "plsc_paths": "source string, target string, estimate double",
    "plsc_loadings": "lv string, indicator string, loading double",
    "plsc_correlations": "lv_a string, lv_b string, correlation double",
    "scores_correlation": "lv_a string, lv_b string, correlation double",
}


def clean(x: float) -> float:
    """No negative zero."""
    return float(x) + 0.0


@dataclass
class Inner:
    """paths: targets x sources. r2 by construct (0 for exogenous)."""

    paths: np.ndarray
    std_error: np.ndarray
    r2: np.ndarray
    r2_adj: np.ndarray
    predictors: list[np.ndarray]


def regress_all(cov: np.ndarray, path: np.ndarray, n: float) -> Inner:
    """Least squares of each endogenous construct, from the ddof-1 covariance of centred scores."""
    k = len(path)
    out = Inner(np.zeros((k, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k), [np.flatnonzero(r) for r in path])
    for i, x in enumerate(out.predictors):
        if not len(x):
            continue
        inside = cov[np.ix_(x, x)]
        beta = np.linalg.solve(inside, cov[x, i])
        rest = max(cov[i, i] - beta @ cov[x, i], 0.0) * (n - 1)
        df = n - len(x) - 1
        out.paths[i, x] = beta
        out.r2[i] = 1 - rest / (cov[i, i] * (n - 1))
        if df > 0:
            out.std_error[i, x] = np.sqrt(rest / df * np.diag(np.linalg.inv(inside)) / (n - 1))
            out.r2_adj[i] = 1 - (1 - out.r2[i]) * (n - 1) / df
    return out


def powers(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indirect, total) effects."""
    total = np.linalg.inv(np.eye(len(paths)) - paths) - np.eye(len(paths))
    return total - paths, total


def bic(r2: float, predictors: int, n: float) -> float:
    return n * math.log(max((1 - r2) * (n - 1), 1e-12) / n) + (predictors + 1) * math.log(n)


def chains(path: np.ndarray) -> list[list[int]]:
    """All simple chains of at least three constructs along the declared paths."""
    out: list[list[int]] = []

    def walk(chain: list[int]) -> None:
        for t in np.flatnonzero(path[:, chain[-1]]).tolist():
            if t not in chain:
                if len(chain) >= 2:
                    out.append([*chain, t])
                walk([*chain, t])

    for s in range(len(path)):
        walk([s])
    return out


def effect_size(f2: float) -> str:
    if math.isnan(f2):
        return "none"
    return "large" if f2 >= 0.35 else "medium" if f2 >= 0.15 else "small" if f2 >= 0.02 else "none"


def geometric_mean(x: np.ndarray) -> float:
    return NAN if (x == 0).any() or np.isnan(x).any() else float(np.exp(np.log(x).mean()))


class Tables:
    """Every table that a solution gives. blocks are in path order; path has rows as targets."""

    def __init__(self, solution: Solution, blocks: Sequence[Block], path: np.ndarray):
        self.s = solution
        self.blocks = list(blocks)
        self.path = np.asarray(path)
        self.lvs, self.mvs = solution.lvs, solution.mvs
        self.n = solution.treated.n
        self.inner = regress_all(solution.score_cov, self.path, self.n)
        self.where = {b.lv: [self.mvs.index(m) for m in b.names] for b in self.blocks}
        sd = np.sqrt(np.diag(solution.score_cov))
        self.score_corr = solution.score_cov / np.outer(sd, sd)
        self.own = np.array([self.lvs.index(b.lv) for b in self.blocks for _ in b.names])
        self.loading = solution.cross[np.arange(len(self.mvs)), self.own]

    # measurement model
    def outer_model(self) -> list[tuple]:
        rows = []
        for j, mv in enumerate(self.mvs):
            k, x = self.own[j], self.loading[j]
            rows.append((mv, self.lvs[k], clean(self.s.weights[j].sum()), clean(x), clean(x * x), clean(x * x * self.inner.r2[k])))
        return sorted(rows)

    def crossloadings(self) -> list[tuple]:
        return [(mv, self.lvs[self.own[j]], lv, clean(self.s.cross[j, k])) for j, mv in enumerate(self.mvs) for k, lv in enumerate(self.lvs)]

    def communality(self, lv: str) -> float:
        return float((self.loading[self.where[lv]] ** 2).mean())

    def ave(self, b: Block) -> float:
        return self.communality(b.lv) if b.mode is Mode.A else NAN

    # structural model
    def inner_model(self) -> list[tuple]:
        rows = []
        for i, x in enumerate(self.inner.predictors):
            for j in x:
                b, se, df = self.inner.paths[i, j], self.inner.std_error[i, j], self.n - len(x) - 1
                t = b / se if se > 0 else NAN
                rows.append((self.lvs[j], self.lvs[i], clean(b), clean(se), clean(t), clean(t_two_sided(t, df))))
        return rows

    def path_coefficients(self) -> list[tuple]:
        return [(a, b, clean(self.inner.paths[i, j])) for i, a in enumerate(self.lvs) for j, b in enumerate(self.lvs)]

    def effects(self, paths: np.ndarray | None = None) -> list[tuple]:
        paths = self.inner.paths if paths is None else paths
        indirect, total = powers(paths)
        reach = np.linalg.inv(np.eye(len(self.path)) - self.path) - np.eye(len(self.path)) > 0.5
        rows = []
        for j, a in enumerate(self.lvs):
            for i, b in enumerate(self.lvs):
                if i != j and reach[i, j]:
                    only_direct = not (reach[i, j] and (self.path @ reach)[i, j])
                    rows.append((a, b, clean(paths[i, j]), 0.0 if only_direct else clean(indirect[i, j]), clean(total[i, j])))
        return rows

    def specific_indirect(self, paths: np.ndarray | None = None, source: str | None = None, target: str | None = None, through: Sequence[str] = ()) -> list[tuple]:
        """Products along chains; ``through`` asks for the single chain over exactly these constructs."""
        paths = self.inner.paths if paths is None else paths
        for lv in (source, target, *through):
            if lv is not None and lv not in self.lvs:
                raise ValueError(f"{lv} is not a construct of the model")
        if source is not None and source == target:
            raise ValueError("source and target must differ")
        rows = []
        for c in chains(self.path):
            names = [self.lvs[k] for k in c]
            if source not in (None, names[0]) or target not in (None, names[-1]) or (through and list(through) != names[1:-1]):
                continue
            rows.append((names[0], names[-1], names[1:-1], clean(np.prod([paths[b, a] for a, b in zip(c, c[1:])]))))
        return rows

    def inner_summary(self) -> list[tuple]:
        rows = []
        for b in self.blocks:
            k = self.lvs.index(b.lv)
            x = self.inner.predictors[k]
            c = self.communality(b.lv)
            r2 = self.inner.r2[k]
            rows.append((b.lv, "Endogenous" if len(x) else "Exogenous", clean(r2), clean(self.inner.r2_adj[k]), c, c * r2, self.ave(b), bic(r2, len(x), self.n) if len(x) else NAN))
        return sorted(rows)

    def goodness_of_fit(self) -> float:
        many = [b for b in self.blocks if len(b.indicators) > 1]
        r2 = self.inner.r2[self.inner.r2 != 0]
        if not many or not len(r2):
            raise ValueError("goodness of fit needs a construct with several indicators and an endogenous one")
        sizes = np.array([len(b.indicators) for b in many])
        mean = (np.array([self.communality(b.lv) for b in many]) * sizes).sum() / sizes.sum()
        return float(np.sqrt(mean * r2.mean()))

    # reliability and validity
    def reliability(self) -> list[tuple]:
        return [reliability_row(b, self.corr_of(b)) for b in self.blocks]

    def corr_of(self, b: Block) -> np.ndarray:
        return self.s.treated.select(b.names).corr

    def fornell_larcker(self) -> list[tuple]:
        rows = []
        for b in self.blocks:
            k = self.lvs.index(b.lv)
            others = np.abs(np.delete(self.score_corr[k], k))
            most = float(others.max()) if len(others) else NAN
            ave = self.ave(b)
            if math.isnan(ave):
                rows.append((b.lv, NAN, most, None, "formative: no AVE"))
            else:
                rows.append((b.lv, math.sqrt(ave), most, bool(math.sqrt(ave) > most), ""))
        return rows

    def scores_correlation(self) -> list[tuple]:
        return [(a, b, clean(self.score_corr[i, j])) for i, a in enumerate(self.lvs) for j, b in enumerate(self.lvs)]

    def f_squared(self) -> list[tuple]:
        rows = []
        for i, x in enumerate(self.inner.predictors):
            full = self.inner.r2[i]
            for j in x:
                rest = x[x != j]
                c = self.s.score_cov
                reduced = float(c[i, rest] @ np.linalg.solve(c[np.ix_(rest, rest)], c[rest, i]) / c[i, i]) if len(rest) else 0.0
                f2 = INF if full >= NEAR_ONE else (full - reduced) / (1 - full)
                rows.append((self.lvs[j], self.lvs[i], clean(full), clean(reduced), clean(f2), effect_size(f2)))
        return rows

    def vif_items(self) -> list[tuple]:
        rows = []
        for b in self.blocks:
            if len(b.indicators) >= 2:
                rows += [(b.lv, m, v) for m, v in zip(b.names, vif(self.corr_of(b)))]
        return rows

    def vif_inner(self) -> list[tuple]:
        rows = []
        for i, x in enumerate(self.inner.predictors):
            if len(x) >= 2:
                rows += [(self.lvs[i], self.lvs[j], v) for j, v in zip(x, vif(self.score_corr[np.ix_(x, x)]))]
        return rows

    def implied(self, loading: np.ndarray, phi: np.ndarray) -> np.ndarray:
        """Correlations of indicators that loadings and construct correlations imply."""
        lam = np.zeros((len(self.mvs), len(self.lvs)))
        lam[np.arange(len(self.mvs)), self.own] = loading
        out = lam @ phi @ lam.T
        np.fill_diagonal(out, 1.0)
        return out

    def residual_pairs(self, loading: np.ndarray | None = None, phi: np.ndarray | None = None) -> list[tuple]:
        """Lower triangle without pairs inside one formative block."""
        diff = self.s.treated.corr - self.implied(self.loading if loading is None else loading, self.score_corr if phi is None else phi)
        formative = {self.lvs.index(b.lv) for b in self.blocks if b.mode is Mode.B}
        rows = []
        for i in range(len(self.mvs)):
            for j in range(i):
                if not (self.own[i] == self.own[j] and self.own[i] in formative):
                    rows.append((self.mvs[i], self.mvs[j], clean(diff[i, j])))
        return rows

    def fit_indices(self, **of) -> tuple[float, float]:
        """(srmr, d_uls)."""
        r = np.array([x[2] for x in self.residual_pairs(**of)])
        return (float(np.sqrt((r**2).mean())), float((r**2).sum())) if len(r) else (NAN, NAN)

    def ratio(self, kind: Callable[[np.ndarray], float], column: str, corr: np.ndarray | None = None) -> list[tuple]:
        """HTMT and HTMT2: ``kind`` averages absolute correlations; reflective blocks of two and more."""
        r = np.abs(self.s.treated.corr if corr is None else corr)
        able = [b for b in self.blocks if b.mode is Mode.A and len(b.indicators) >= 2]

        def within(b: Block) -> float:
            at = self.where[b.lv]
            return kind(np.array([r[i, j] for i, j in combinations(at, 2)]))

        rows = []
        for a, b in combinations(able, 2):
            base = within(a) * within(b)
            between = kind(r[np.ix_(self.where[a.lv], self.where[b.lv])].ravel())
            rows.append((a.lv, b.lv, clean(between / math.sqrt(base)) if base > 0 else NAN))
        return rows

    def htmt(self) -> list[tuple]:
        return self.ratio(lambda x: float(x.mean()), "htmt")

    def htmt2(self, corr: np.ndarray | None = None) -> list[tuple]:
        return self.ratio(geometric_mean, "htmt2", corr)


def reliability_row(b: Block, corr: np.ndarray) -> tuple:
    """Alpha, rho and the two largest eigenvalues from a block's correlations; none of the first two
    for formative blocks."""
    p = len(corr)
    values, vectors = np.linalg.eigh(corr)
    first, second = float(values[-1]), float(values[-2]) if p > 1 else NAN
    alpha = rho = NAN
    if b.mode is Mode.A:
        total = corr.sum()
        alpha = max(0.0, p / (p - 1) * (total - p) / total) if p > 1 else NAN
        with_first = vectors[:, -1] * math.sqrt(max(first, 0.0))
        square = with_first.sum() ** 2
        rho = float(square / (square + p - (with_first**2).sum()))
    return (b.lv, b.mode.value, p, alpha, rho, first, second)


def vif(corr: np.ndarray) -> list[float]:
    """1 / (1 - R2) of each column on the others: inf where it is determined by them, NaN without
    variance."""
    out = []
    for i in range(len(corr)):
        rest = [j for j in range(len(corr)) if j != i]
        if np.isnan(corr[i]).all():
            out.append(NAN)
            continue
        x = corr[np.ix_(rest, rest)]
        r2 = float(corr[i, rest] @ np.linalg.lstsq(x, corr[rest, i], rcond=None)[0])
        out.append(INF if r2 >= NEAR_ONE else 1 / (1 - r2))
    return out


class Consistent:
    """Disattenuated (consistent) estimates: reflective blocks by rho_A, others as they are."""

    def __init__(self, t: Tables):
        self.t = t
        s = t.s.treated.corr
        scale = t.s.treated.sd
        k = len(t.lvs)
        self.rho, self.loading = np.ones(k), t.loading.copy()
        for b in t.blocks:
            i, at = t.lvs.index(b.lv), t.where[b.lv]
            if b.mode is not Mode.A or len(at) < 2:
                continue
            w = t.s.weights[at, i] * scale[at]
            block = s[np.ix_(at, at)]
            w = w / math.sqrt(w @ block @ w)
            outer = np.outer(w, w)
            off = lambda m: m - np.diag(np.diag(m))
            self.rho[i] = (w @ w) ** 2 * (w @ off(block) @ w) / (w @ off(outer) @ w)
            self.loading[at] = w * math.sqrt(max(self.rho[i], 0.0)) / (w @ w) * t.s.signs[i]
        root = np.sqrt(np.outer(self.rho, self.rho))
        self.phi = t.score_corr / root
        np.fill_diagonal(self.phi, 1.0)
        self.inner = regress_all(self.phi, t.path, t.n)

    def summary(self) -> list[tuple]:
        rows = []
        for b in self.t.blocks:
            i, at = self.t.lvs.index(b.lv), self.t.where[b.lv]
            x = self.inner.predictors[i]
            able = b.mode is Mode.A
            lam = self.loading[at]
            ave = float((lam**2).mean()) if able else NAN
            rho_c = float(lam.sum() ** 2 / (lam.sum() ** 2 + (1 - lam**2).sum())) if able else NAN
            r2 = float(self.inner.r2[i])
            rows.append((b.lv, float(self.rho[i]), ave, rho_c, r2, float(self.inner.r2_adj[i]), bic(r2, len(x), self.t.n) if len(x) else NAN))
        return rows

    def paths(self) -> list[tuple]:
        return [(self.t.lvs[j], self.t.lvs[i], clean(self.inner.paths[i, j])) for i, x in enumerate(self.inner.predictors) for j in x]

    def loadings(self) -> list[tuple]:
        return [(self.t.lvs[self.t.own[j]], m, clean(self.loading[j])) for j, m in enumerate(self.t.mvs)]

    def correlations(self) -> list[tuple]:
        return [(a, b, clean(self.phi[i, j])) for i, a in enumerate(self.t.lvs) for j, b in enumerate(self.t.lvs)]

    def htmt(self) -> np.ndarray:
        out = np.abs(self.phi)
        np.fill_diagonal(out, NAN)
        return out

    def vif_inner(self) -> list[tuple]:
        rows = []
        for i, x in enumerate(self.inner.predictors):
            if len(x) >= 2:
                rows += [(self.t.lvs[i], self.t.lvs[j], v) for j, v in zip(x, vif(self.phi[np.ix_(x, x)]))]
        return rows

    def fit_indices(self) -> tuple[float, float]:
        return self.t.fit_indices(loading=self.loading, phi=self.phi)
