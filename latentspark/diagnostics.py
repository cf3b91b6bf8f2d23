"""Importance-performance maps, tetrad analysis, Gaussian copulas and a report of everything."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latentspark.kernel.dist import NORMAL, cramer_von_mises_from_statistic, normal_two_sided
from latentspark.model import FittedModel
from latentspark.moments import Moments, moments
from latentspark.resample import REP_BLOCK, replicate_sums, sums_to_moments
from latentspark.spec import Mode


def ipma(fit: FittedModel, target: str, scale: tuple[float, float] | None = None, scales: dict[str, tuple[float, float]] | None = None, df: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(constructs, indicators): importance (total effect on the target) and performance (0 to 100).

    Bounds of an indicator: ``scales``, else ``scale``, else its observed minimum and maximum. df: the
    rows to rate, by default those of the fit; a construct's performance averages rows with its whole
    block. Weights that sum to 0 are normalised by their absolute sum.
    """
    if target not in fit.model.lvs:
        raise ValueError(f"{target} is not a construct of the model")
    if scale is not None and scale[1] <= scale[0]:
        raise ValueError("the scale's maximum must lie above its minimum")
    t, model = fit.tables, fit.model
    data = fit.data() if df is None else df
    weight = {r[0]: r[2] for r in t.outer_model()}
    total = {r[0]: r[4] for r in t.effects() if r[1] == target}
    blocks = [b for b in t.blocks if all(m in data.columns for m in b.names)]
    mvs = [m for b in blocks for m in b.names]
    limits = data.agg(*[f(F.col(f"`{m}`").cast("double")).alias(f"{a}{i}") for i, m in enumerate(mvs) for a, f in (("lo", F.min), ("hi", F.max))]).first()
    bounds = {m: (scales or {}).get(m) or scale or (limits[f"lo{i}"], limits[f"hi{i}"]) for i, m in enumerate(mvs)}

    def rated(m: str):
        lo, hi = (float(x) if x is not None else float("nan") for x in bounds[m])
        return (F.col(f"`{m}`").cast("double") - lo) * (100.0 / (hi - lo) if hi > lo else float("nan"))

    norm = {}
    aggs = [F.avg(rated(m)).alias(f"m{i}") for i, m in enumerate(mvs)]
    for i, b in enumerate(blocks):
        w = np.array([weight[m] for m in b.names])
        w = w / w.sum() if w.sum() else w / max(np.abs(w).sum(), 1e-300)
        norm |= dict(zip(b.names, w))
        score = sum((rated(m) * float(norm[m]) for m in b.names[1:]), rated(b.names[0]) * float(norm[b.names[0]]))
        aggs.append(F.avg(score).alias(f"b{i}"))  # NULL where any of the block is
    got = data.agg(*aggs).first()
    lv_rows = [(b.lv, total[b.lv], got[f"b{i}"]) for i, b in enumerate(blocks) if b.lv != target and total.get(b.lv)]
    nan = float("nan")
    of = {m: b.lv for b in blocks for m in b.names}
    mv_rows = []
    for i, m in enumerate(mvs):
        effect = total.get(of[m], nan)
        mv_rows.append((of[m], m, weight[m], float(norm[m]), weight[m] * effect, weight[m] if effect and effect == effect else nan, got[f"m{i}"], *map(float, bounds[m])))
    columns = "outer_weight normalized_weight indicator_importance henseler_normalized_weight performance scale_min scale_max"
    return (
        fit.spark.createDataFrame(lv_rows, "lv string, importance double, performance double"),
        fit.spark.createDataFrame(mv_rows, "lv string, indicator string, " + ", ".join(f"{c} double" for c in columns.split())),
    )


def tetrads(cov: np.ndarray) -> np.ndarray:
    """s_ij s_kl - s_ik s_jl of every four columns."""
    return np.array([cov[i, j] * cov[k, m] - cov[i, k] * cov[j, m] for i, j, k, m in combinations(range(len(cov)), 4)])


def holm(p: Sequence[float], alpha: float) -> list[bool]:
    """Step-down rejections."""
    out = [False] * len(p)
    for rank, i in enumerate(sorted(range(len(p)), key=lambda i: p[i])):
        if p[i] >= alpha / (len(p) - rank):
            break
        out[i] = True
    return out


def cta(fit: FittedModel, row_id: str, reps: int = 500, alpha: float = 0.05, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(tetrads, summary): confirmatory tetrad analysis of reflective blocks of four and more, of a fit
    made with ``keep=[row_id]``. The p-value is the share of centred bootstrap tetrads at least as large
    as the observed, not below 1 / reps; decisions are Holm's within a block."""
    if reps < 50 or not 0 < alpha < 1:
        raise ValueError("at least 50 replicates and an alpha between 0 and 1")
    names = list(fit.prepared.moments.names)
    blocks = [b for b in fit.tables.blocks if b.mode is Mode.A and len(b.indicators) >= 4 and all(n in names for n in b.names)]
    if fit.prepared.moments.n < 10:
        blocks = []
    rows, summary = [], []
    if blocks:
        columns = [n for b in blocks for n in b.names]
        m = fit.prepared.moments.select(columns)
        data = fit.data().withColumn("_h", F.xxhash64(F.col(f"`{row_id}`")))
        parts = replicate_sums(data, "_h", columns, m.mean, reps, seed)
        centre, p = m.mean, len(columns)
        where = [[columns.index(n) for n in b.names] for b in blocks]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            data = np.sum([np.frombuffer(d) for d in pdf["data"]], axis=0).reshape(-1, 1 + p + p * (p + 1) // 2)
            out = []
            for i, sums in enumerate(data):
                cov = sums_to_moments(columns, centre, sums).cov
                for b, at in enumerate(where):
                    out += [(int(pdf["block"].iloc[0]) * REP_BLOCK + i, b, k, float(v)) for k, v in enumerate(tetrads(cov[np.ix_(at, at)]))]
            return pd.DataFrame(out, columns=["rep", "b", "t", "v"])

        draws = parts.groupBy("block").applyInPandas(run, "rep int, b int, t int, v double")
        observed = [(b, t, float(v)) for b, at in enumerate(where) for t, v in enumerate(tetrads(m.cov[np.ix_(at, at)]))]
        base = fit.spark.createDataFrame(observed, "b int, t int, o double")
        stats = draws.groupBy("b", "t").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("se"))
        far = F.abs(F.col("v") - F.col("mean")) >= F.abs("o")
        joined = draws.join(stats, ["b", "t"]).join(base, ["b", "t"]).groupBy("b", "t", "o", "se").agg(F.avg(far.cast("double")).alias("p"))
        found = {(r["b"], r["t"]): r for r in joined.collect()}  # one row per tetrad
        for k, b in enumerate(blocks):
            quads = list(combinations(b.names, 4))
            got = [found[k, t] for t in range(len(quads))]
            ps = [max(r["p"], 1 / reps) for r in got]
            rejected = holm(ps, alpha)
            rows += [(b.lv, ",".join(q), r["o"], r["se"], pv, "reject" if x else "fail to reject") for q, r, pv, x in zip(quads, got, ps, rejected)]
            summary.append((b.lv, len(b.names), len(quads), sum(rejected), "reflective rejected" if any(rejected) else "reflective supported"))
    return (
        fit.spark.createDataFrame(rows, "lv string, indicators string, tetrad double, boot_se double, p_value double, holm_decision string"),
        fit.spark.createDataFrame(summary, "lv string, n_indicators int, n_tetrads int, n_rejected int, decision string"),
    )


RANK_BUCKETS = 256


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """(value, n, below, rank) per distinct value: rows equal to it, rows below it and the average rank.

    Values are cut into ranges at approximate quantiles; any cuts give exact ranks, and no task sorts
    more than a range of distinct values, whatever the ties. NULL and NaN have no rank.
    """
    v = df.select(F.col(f"`{column}`").cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    counts = v.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    cuts = sorted(set(counts.approxQuantile("value", [i / RANK_BUCKETS for i in range(1, RANK_BUCKETS)], 1 / (4 * RANK_BUCKETS))))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("value"))) if cuts else F.lit(0)
    counts = counts.withColumn("_b", bucket)
    sums = counts.groupBy("_b").agg(F.sum("n").alias("_n"))  # at most RANK_BUCKETS rows
    ahead = sums.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("_b").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = counts.withColumn("_inside", inside).join(ahead, F.col("_b") == F.col("_c"))
    below = F.col("_ahead") + F.col("_inside")
    return x.select("value", "n", below.alias("below"), (below + (F.col("n") + 1) / 2).alias("rank"))


def copula(fit: FittedModel, row_id: str, endogenous: str, suspected: Sequence[str] | None = None, reps: int = 500, seed: int = 42, alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(summary, augmented paths): endogeneity of predictors by Gaussian copula terms, of a fit made
    with ``keep=[row_id]``. A term is the normal quantile of average rank / (n + 1)."""
    if reps < 50:
        raise ValueError("at least 50 replicates")
    if endogenous not in fit.model.lvs:
        raise ValueError(f"{endogenous} is not a construct of the model")
    predictors = [p for p in fit.model.lvs if fit.model.path.loc[endogenous, p]]
    if not predictors:
        raise ValueError(f"{endogenous} has no predecessors")
    suspected = list(predictors if suspected is None else suspected)
    if set(suspected) - set(predictors):
        raise ValueError(f"not predecessors of {endogenous}: {sorted(set(suspected) - set(predictors))}")
    scores = fit.scores([row_id])
    n = fit.prepared.moments.n
    base = moments(scores, [*suspected])
    x = scores.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{endogenous}`").alias("y"), *[F.col(f"`{p}`").alias(f"x{i}") for i, p in enumerate(predictors)])
    normality = {}
    for k, lv in enumerate(suspected):
        ranks = average_ranks(scores, lv)
        mean, sd = float(base.mean[k]), float(base.sd[k])

        def terms(batches: Iterator[pd.DataFrame], mean=mean, sd=sd) -> Iterator[pd.DataFrame]:
            for b in batches:
                r, c, below = (b[q].to_numpy(dtype=float) for q in ("rank", "n", "below"))
                u = np.array([NORMAL.cdf((v - mean) / sd) for v in b["value"]])
                middle = (2 * below + c) / (2 * n)
                w = c * (u - middle) ** 2 + (c**3 - c) / (12 * n**2)
                yield pd.DataFrame({"value": b["value"], "term": [NORMAL.inv_cdf(q / (n + 1)) for q in r], "w": w})

        table = ranks.mapInPandas(terms, "value double, term double, w double")
        normality[lv] = cramer_von_mises_from_statistic(1 / (12 * n) + table.agg(F.sum("w")).first()[0], n)
        own = f"x{predictors.index(lv)}"
        x = x.join(table.select(F.col("value").alias(own), F.col("term").alias(f"c{k}")), own)
    columns = ["y", *[f"x{i}" for i in range(len(predictors))], *[f"c{k}" for k in range(len(suspected))]]

    def regress(m: Moments) -> np.ndarray:
        return np.linalg.solve(m.cov[1:, 1:], m.cov[1:, 0])

    all_rows = moments(x, columns)
    b = regress(all_rows)
    parts = replicate_sums(x.withColumn("_h", F.xxhash64("_id")), "_h", columns, all_rows.mean, reps, seed)
    centre, p = all_rows.mean, len(columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.frombuffer(d) for d in pdf["data"]], axis=0).reshape(-1, 1 + p + p * (p + 1) // 2)
        out = []
        for sums in data:
            try:
                out += [(k, float(v)) for k, v in enumerate(regress(sums_to_moments(columns, centre, sums))[len(predictors) :])]
            except np.linalg.LinAlgError:
                continue
        return pd.DataFrame(out, columns=["k", "v"])

    drawn = parts.groupBy("block").applyInPandas(run, "k int, v double").groupBy("k").agg(F.count("v").alias("n"), F.stddev_samp("v").alias("se")).collect()
    se = {r["k"]: r["se"] for r in drawn}
    if not drawn or min(r["n"] for r in drawn) < 50:
        raise RuntimeError("fewer than 50 replicates could be fitted")
    rows = []
    for k, lv in enumerate(suspected):
        gamma = float(b[len(predictors) + k])
        t = gamma / se[k] if se[k] > 0 else float("nan")
        pv = normal_two_sided(t)
        says = "copula not admissible (normal)" if normality[lv] > alpha else "inconclusive" if pv != pv else "endogeneity detected" if pv <= alpha else "no endogeneity detected"
        rows.append((lv, gamma, se[k], t, pv, normality[lv], says))
    return (
        fit.spark.createDataFrame(rows, "predictor string, gamma double, boot_se double, t double, p_value double, cvm_p_nonnormal double, decision string"),
        fit.spark.createDataFrame([(q, endogenous, float(v)) for q, v in zip(predictors, b)], "source string, target string, estimate double"),
    )


def report(fit: FittedModel) -> dict[str, DataFrame]:
    """The tables of a usual write-up by name."""
    rel, con, summary = fit.reliability(), fit.plsc_summary(), fit.inner_summary()
    return {
        "reliability": rel.select("lv", "mode", "mvs", "cronbach_alpha", F.col("dillon_goldstein_rho").alias("rho_c")).join(con.select("lv", "rho_a"), "lv").join(summary.select("lv", "ave"), "lv"),
        "fornell_larcker": fit.fornell_larcker(),
        "htmt": fit.htmt(),
        "paths": fit.inner_model().join(fit.f_squared().select("source", "target", "f_squared", "effect_size"), ["source", "target"]),
        "construct_summary": summary.join(rel.select("lv", "mvs"), "lv"),
        "fit_indices": fit.model_fit(),
        "collinearity_items": fit.vif(),
        "collinearity_inner": fit.vif_inner(),
    }


def write_report(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table of a report as a folder of its name below ``folder``, in any format Spark writes."""
    for name, df in tables.items():
        df.write.format(form).mode("errorifexists").option("header", True).save(f"{folder.rstrip('/')}/{name}")
