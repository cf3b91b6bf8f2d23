"""Comparing groups: permutation and bootstrap multi-group analysis, measurement invariance.

A permutation assigns every row to the first group by the smallest hashes: rows with a hash below the
quantile that leaves the group its size. A replicate's first-group moments come from the pass that
makes bootstrap moments, with 0/1 weights; the other group's moments are the total's minus these.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.kernel.dist import normal_two_sided
from latentspark.kernel.weights import Extended, NoConvergence
from latentspark.model import MAX_CATEGORIES, complete_rows, estimate, filled_rows, fit, usable_rows
from latentspark.moments import Moments, grouped_moments
from latentspark.resample import REP_BLOCK, bias_corrected, bootstrap, entities, henseler_p, parametric_t, replicate_sums, sums_to_moments, uniforms, welch_t
from latentspark.spec import PathModel, Scale, Scheme


@dataclass(frozen=True)
class Group:
    """Rows whose value is in ``values``, or (preferred) between low and high, both inclusive; None is
    unbounded. Text that is no number lies in no range."""

    name: str
    values: tuple = ()
    low: float | None = None
    high: float | None = None

    def predicate(self, c: Column) -> Column:
        if self.low is None and self.high is None:
            return F.coalesce(c.cast("string").isin([str(v) for v in self.values]), F.lit(False))
        x = c.try_cast("double")
        inside = F.lit(True)
        if self.low is not None:
            inside = inside & (x >= self.low)
        if self.high is not None:
            inside = inside & (x <= self.high)
        return F.coalesce(inside, F.lit(False))


@dataclass
class _Split:
    """rows: each group's complete rows (dummies in place of ORD and NOM indicators). moments: of each."""

    rows: dict[str, DataFrame]
    moments: dict[str, Moments]
    levels: dict[str, list[str]]


def _split(df: DataFrame, model: PathModel, column: str, groups: Sequence[Group], keep: Sequence[str] = ()) -> _Split:
    """One aggregation gives all groups' means and moments; gaps are read as the group's mean."""
    if len(groups) < 2 or len({g.name for g in groups}) < len(groups):
        raise ValueError("at least two groups with different names")
    model.check(df.columns)
    names = [i.name for i in model.indicators]
    graded = [i.name for i in model.indicators if i.scale in (Scale.ORD, Scale.NOM)]
    parts = {g.name: df.filter(g.predicate(F.col(f"`{column}`"))) for g in groups}
    rows = {g: complete_rows(d, model, "casewise", keep) if graded else usable_rows(d, model, "casewise", keep) for g, d in parts.items()}

    def union(columns: Sequence[str]) -> DataFrame:
        both = None
        for g, d in rows.items():
            one = d.select(F.lit(g).alias("_g"), *[F.col(f"`{n}`") for n in columns])
            both = one if both is None else both.unionByName(one)
        return both

    levels: dict[str, list[str]] = {}
    for m in graded:
        found = sorted(r[0] for r in union([m]).select(f"`{m}`").distinct().limit(MAX_CATEGORIES + 1).collect())
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"{m} has more than {MAX_CATEGORIES} categories")
        levels[m] = [f"{m}={k}" for k in range(len(found))]
        for g, d in rows.items():
            rows[g] = d.select("*", *[F.when(F.col(f"`{m}`") == v, 1.0).otherwise(0.0).alias(c) for v, c in zip(found, levels[m])])
    wide = [n for n in names if n not in levels] + [c for m in graded for c in levels[m]]
    moments = grouped_moments(union(wide), wide, {"_g": "string"}, gaps="drop" if graded else "mean")
    for g in rows:
        if g not in moments or moments[g].n < 2:
            raise ValueError(f"group {g} has too few rows")
        if not graded:
            rows[g] = filled_rows(rows[g], names, dict(zip(wide, moments[g].mean.tolist())), keep)
    return _Split(rows, moments, levels)


def group_estimates(df: DataFrame, model: PathModel, column: str, groups: Sequence[Group], scheme: Scheme = Scheme.CENTROID, tolerance: float = 1e-6) -> DataFrame:
    """(grp, n, source, target, estimate): the paths of each group, from one aggregation."""
    found = _split(df, model, column, groups)
    rows = []
    for g in groups:
        m = found.moments[g.name]
        e = estimate(model, Extended(m, found.levels).present(), scheme, tolerance)
        rows += [(g.name, int(m.n), r[0], r[1], r[2]) for r in e.tables.inner_model()]
    return df.sparkSession.createDataFrame(rows, "grp string, n bigint, source string, target string, estimate double")


def _split_draws(a: DataFrame, b: DataFrame, row_id: str, model: PathModel, reps: int, seed: int, solve, schema: str, total: Moments, n_a: float) -> DataFrame:
    """Runs ``solve(rep, moments_a, moments_b)`` over random splits of both groups' rows."""
    names = list(total.names)
    pooled = a.unionByName(b).withColumn("_h", F.xxhash64(F.col(f"`{row_id}`")))
    share = n_a / total.n
    centre = total.mean

    def weigh(ids: np.ndarray, some: np.ndarray, seed: int) -> np.ndarray:
        return (uniforms(ids, some, seed) < share).astype(np.float64)

    parts = replicate_sums(pooled, "_h", names, centre, reps, seed, weigh)
    p = len(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.frombuffer(d) for d in pdf["data"]], axis=0).reshape(-1, 1 + p + p * (p + 1) // 2)
        out = []
        for i, sums in enumerate(data):
            first = sums_to_moments(names, centre, sums)
            try:
                out += solve(int(pdf["block"].iloc[0]) * REP_BLOCK + i, first, total.minus(first))
            except (NoConvergence, np.linalg.LinAlgError):  # counted: valid splits are those with draws
                continue
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return parts.groupBy("block").applyInPandas(run, schema)


def permutation_mga(
    df: DataFrame, model: PathModel, column: str, groups: Sequence[Group], row_id: str, scheme: Scheme = Scheme.CENTROID, reps: int = 5000, seed: int = 42, tolerance: float = 1e-6
) -> DataFrame:
    """(group_a, group_b, source, target, estimate_a, estimate_b, difference, p_value, valid) of each
    pair of groups; p = (splits with |difference| at least the observed + 1) / (valid splits + 1).

    Split sizes vary around the group's share (each row is drawn by its own hash)."""
    spark = df.sparkSession
    found = _split(df, model, column, groups, [row_id])
    levels, out = found.levels, None
    for i, ga in enumerate(groups):
        for gb in groups[i + 1 :]:
            ma, mb = found.moments[ga.name], found.moments[gb.name]
            paths = [{(r[0], r[1]): r[2] for r in estimate(model, Extended(m, levels).present(), scheme, tolerance).tables.inner_model()} for m in (ma, mb)]
            observed = [(s, t, paths[0][s, t], paths[1][s, t]) for s, t in paths[0]]

            def solve(rep: int, a: Moments, b: Moments) -> list[tuple]:
                x, y = (estimate(model, Extended(m, levels).present(), scheme, tolerance).tables.inner_model() for m in (a, b))
                return [(rep, p[0], p[1], p[2] - q[2]) for p, q in zip(x, y)]

            draws = _split_draws(found.rows[ga.name], found.rows[gb.name], row_id, model, reps, seed, solve, "rep int, source string, target string, diff double", ma.plus(mb), ma.n)
            base = spark.createDataFrame(observed, "source string, target string, estimate_a double, estimate_b double")
            far = F.abs(F.col("diff")) >= F.abs(F.col("estimate_a") - F.col("estimate_b"))
            one = base.join(draws, ["source", "target"], "left").groupBy("source", "target", "estimate_a", "estimate_b")
            one = one.agg(F.count("diff").alias("valid"), F.count(F.when(far, 1)).alias("_far"))
            one = one.select(
                F.lit(ga.name).alias("group_a"), F.lit(gb.name).alias("group_b"), "source", "target", "estimate_a", "estimate_b",
                (F.col("estimate_a") - F.col("estimate_b")).alias("difference"), ((F.col("_far") + 1) / (F.col("valid") + 1)).alias("p_value"), "valid",
            )
            out = one if out is None else out.unionByName(one)
    return out


def bootstrap_mga(
    df: DataFrame, model: PathModel, column: str, groups: Sequence[Group], row_id: str, scheme: Scheme = Scheme.CENTROID, reps: int = 5000, seed: int = 42, alpha: float = 0.05
) -> DataFrame:
    """Exactly two groups, each bootstrapped by itself: per entity (paths, loadings, weights, total and
    indirect effects) both groups' statistics, their difference, Henseler's p and two t tests."""
    if len(groups) != 2:
        raise ValueError("a bootstrap comparison needs exactly two groups")
    both, sizes = [], []
    for k, g in enumerate(groups):
        f = fit(df.filter(g.predicate(F.col(f"`{column}`"))), model, scheme, missing="casewise", keep=[row_id])
        sizes.append(f.prepared.moments.n)
        r = bootstrap(f, row_id, reps, seed + k)
        point = df.sparkSession.createDataFrame(entities(model, f.estimate), "kind string, a string, b string, original double")
        good = r.draws.filter("kind <> 'failed'").groupBy("kind", "a", "b").agg(F.sort_array(F.collect_list("value")).alias(f"v{k}"))
        both.append(good.join(point, ["kind", "a", "b"]).withColumnRenamed("original", f"o{k}"))
    joined = both[0].join(both[1], ["kind", "a", "b"])
    n = [float(x) for x in sizes]
    names = "kind a b original_1 mean_1 std_error_1 t_1 p_1 ci_bc_2_5_1 ci_bc_97_5_1 original_2 mean_2 std_error_2 t_2 p_2 ci_bc_2_5_2 ci_bc_97_5_2 difference henseler_p_1tailed henseler_p_2tailed parametric_t parametric_df parametric_p welch_t welch_df welch_p".split()

    def one(original: float, v: np.ndarray) -> list[float]:
        se = float(v.std(ddof=1))
        t = original / se if se > 0 else float("nan")
        return [original, float(v.mean()), se, t, normal_two_sided(t), *bias_corrected(v, original, alpha)]

    def compare(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                v = [np.asarray(r["v0"], dtype=float), np.asarray(r["v1"], dtype=float)]
                s = [one(r[f"o{k}"], v[k]) for k in (0, 1)]
                h = henseler_p(v[0], v[1])
                tests = [f(r["o0"], r["o1"], s[0][2], s[1][2], *n) for f in (parametric_t, welch_t)]
                out.append((r["kind"], r["a"], r["b"], *s[0], *s[1], r["o0"] - r["o1"], h, 2 * min(h, 1 - h), *tests[0], *tests[1]))
            yield pd.DataFrame(out, columns=names)

    schema = ", ".join(f"{x} {'string' if x in ('kind', 'a', 'b') else 'double'}" for x in names)
    return joined.select("kind", "a", "b", "o0", "o1", "v0", "v1").mapInPandas(compare, schema)


@dataclass
class Invariance:
    """step2: (construct, c, p_value, compositional_invariance). step3: differences of means and log
    variance ratios of the pooled composites with p-values. summary: full, partial or none."""

    step2: DataFrame
    step3: DataFrame
    summary: DataFrame
    group_sizes: tuple[int, int]


def _composites(model: PathModel, m: Moments, scheme: Scheme) -> np.ndarray:
    s = estimate(model, Extended(m, {}), scheme).solution
    order = [s.mvs.index(n) for n in m.names]
    return (s.weights * s.signs)[order]


def micom(df: DataFrame, model: PathModel, column: str, groups: Sequence[Group], row_id: str, scheme: Scheme = Scheme.CENTROID, reps: int = 1000, seed: int = 42, alpha: float = 0.05) -> Invariance:
    """Measurement invariance of composites over two groups; both steps use the same splits.

    Configural invariance is taken as given: both groups use one model, one treatment, one scheme.
    """
    if len(groups) != 2:
        raise ValueError("measurement invariance compares exactly two groups")
    a, b = (g.predicate(F.col(f"`{column}`")) for g in groups)
    if df.filter(a & b).limit(1).count():
        raise ValueError("the groups overlap")
    spark = df.sparkSession
    found = _split(df, model, column, groups, [row_id])
    if found.levels:
        raise ValueError("measurement invariance compares composites of numeric indicators")
    rows = found.rows
    ma, mb = (found.moments[g.name] for g in groups)
    pooled = ma.plus(mb)
    sd = pooled.sd
    w_pool = _composites(model, pooled, scheme)
    lvs = model.lvs
    cov, z = pooled.cov, np.where(sd > 0, sd, 1.0)

    def agreement(x: Moments, y: Moments) -> np.ndarray:
        # outer weights as estimated, with the pooled covariances of the untreated columns
        wx, wy = _composites(model, x, scheme), _composites(model, y, scheme)
        num = np.einsum("ik,ij,jk->k", wx, cov, wy)
        return np.abs(num) / np.sqrt(np.einsum("ik,ij,jk->k", wx, cov, wx) * np.einsum("ik,ij,jk->k", wy, cov, wy))

    def level(x: Moments, y: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        turn = w_pool / z[:, None]
        va, vb = (np.einsum("ik,ij,jk->k", turn, m.cov, turn) for m in (x, y))
        return (x.mean - y.mean) @ turn, np.log(va / vb), va - vb

    c = agreement(ma, mb)
    mean_diff, log_ratio, var_diff = level(ma, mb)

    def solve(rep: int, x: Moments, y: Moments) -> list[tuple]:
        d, r, _ = level(x, y)
        cc = agreement(x, y)
        return [(rep, lv, float(cc[k]), float(d[k]), float(r[k])) for k, lv in enumerate(lvs)]

    draws = _split_draws(rows[groups[0].name], rows[groups[1].name], row_id, model, reps, seed, solve, "rep int, construct string, c double, d double, r double", pooled, ma.n)
    base = spark.createDataFrame(
        [(lv, float(c[k]), float(mean_diff[k]), float(log_ratio[k]), float(var_diff[k])) for k, lv in enumerate(lvs)],
        "construct string, c0 double, mean_diff double, log_var_ratio double, var_diff double",
    )
    p = base.join(draws, "construct", "left").groupBy(*base.columns).agg(
        F.count("c").alias("valid"),
        F.count(F.when(F.col("c") <= F.col("c0"), 1)).alias("_c"),
        F.count(F.when(F.abs("d") >= F.abs("mean_diff"), 1)).alias("_d"),
        F.count(F.when(F.abs("r") >= F.abs("log_var_ratio"), 1)).alias("_r"),
    )
    share = lambda x: (F.col(x) + 1) / (F.col("valid") + 1)
    p = p.select(*base.columns, share("_c").alias("pc"), share("_d").alias("pd"), share("_r").alias("pr"))
    step2 = p.select("construct", F.col("c0").alias("c"), F.col("pc").alias("p_value"), (F.col("pc") >= alpha).alias("compositional_invariance"))
    step3 = p.select(
        "construct", "mean_diff", F.col("pd").alias("mean_p_value"), (F.col("pd") >= alpha).alias("mean_equal"),
        "log_var_ratio", "var_diff", F.col("pr").alias("var_p_value"), (F.col("pr") >= alpha).alias("var_equal"),
    )
    ok, equal = F.col("pc") >= alpha, (F.col("pd") >= alpha) & (F.col("pr") >= alpha)
    verdict = F.when(ok & equal, "full").when(ok, "partial").otherwise("none").alias("invariance")
    total = p.select("construct", F.col("c0").alias("c"), ok.alias("compositional_invariance"), "mean_diff", (F.col("pd") >= alpha).alias("mean_equal"), "log_var_ratio", (F.col("pr") >= alpha).alias("var_equal"), verdict)
    return Invariance(step2, step3, total, (int(ma.n), int(mb.n)))
