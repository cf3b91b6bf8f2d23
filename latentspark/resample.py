"""Replicates of a fit: bootstrap weights, replicate moments in one pass, inference tables.

Rows are never copied. Each row gets a Poisson(1) weight per replicate from a hash of its id, so that
the same seed gives the same replicates however the data are partitioned; the replicate's sample size
is the sum of its weights. A task multiplies its replicates x rows weight matrix with the products of
its columns, which yields all replicate moments at once; partial sums are merged per block of
replicates in two steps, and the same kernel that made the fit runs on every replicate's moments in
parallel. No task and no driver step ever holds more than columns^2 numbers per replicate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.kernel.dist import normal_cdf, normal_ppf, normal_two_sided, t_two_sided
from latentspark.kernel.results import powers
from latentspark.kernel.weights import Extended
from latentspark.model import MAX_CATEGORIES, FittedModel, estimate
from latentspark.moments import Moments, task_group
from latentspark.spec import PathModel, Scheme

REP_BLOCK, ROW_BLOCK = 64, 4096
# Cumulative Poisson(1) probabilities of 0, 1, 2, ... events.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 14)]))


def _mix(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned longs, well mixed."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Replicates x rows numbers in [0, 1)."""
    with np.errstate(over="ignore"):
        r = _mix(reps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**63 - 1)))
        x = _mix(ids.astype(np.int64).view(np.uint64)[None, :] + r[:, None])
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def poisson_weights(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    return np.searchsorted(POISSON, uniforms(ids, reps, seed), side="right").astype(np.float64)


def replicate_sums(df: DataFrame, row_hash: str, columns: Sequence[str], centre: np.ndarray, reps: int, seed: int, weigh=poisson_weights) -> DataFrame:
    """(block, part, data): for each block of replicates, sums of [1, x, x x'] about ``centre``; one row
    per block and FAN_IN tasks."""
    cols, p = list(columns), len(columns)
    upper = np.triu_indices(p)
    width = 1 + p + len(upper[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((reps, width))
        for b in batches:
            ids, all_x = b["_h"].to_numpy(dtype=np.int64), b[cols].to_numpy(dtype=float) - centre
            for at in range(0, len(ids), ROW_BLOCK):
                x = all_x[at : at + ROW_BLOCK]
                q = np.concatenate([np.ones((len(x), 1)), x, x[:, upper[0]] * x[:, upper[1]]], axis=1)
                for r in range(0, reps, REP_BLOCK):
                    some = np.arange(r, min(r + REP_BLOCK, reps))
                    total[some] += weigh(ids[at : at + ROW_BLOCK], some, seed) @ q
        blocks = range(0, reps, REP_BLOCK)
        yield pd.DataFrame({"block": [r // REP_BLOCK for r in blocks], "part": task_group(), "data": [total[r : r + REP_BLOCK].tobytes() for r in blocks]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.frombuffer(d) for d in pdf["data"]], axis=0)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1], "data": [data.tobytes()]})

    schema = "block int, part int, data binary"
    # a row costs replicates x columns^2 steps, so rows are dealt out evenly, however few files hold them
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(F.col(row_hash).alias("_h"), *[F.col(f"`{c}`") for c in cols]).repartition(cores, "_h")
    return rows.mapInPandas(run, schema).groupBy("block", "part").applyInPandas(add, schema)


def sums_to_moments(names: Sequence[str], centre: np.ndarray, sums: np.ndarray) -> Moments:
    p = len(names)
    n = float(sums[0])
    mean = sums[1 : p + 1] / max(n, 1e-300)
    second = np.zeros((p, p))
    second[np.triu_indices(p)] = sums[p + 1 :]
    second = second + np.triu(second, 1).T
    return Moments(tuple(names), n, centre + mean, second - n * np.outer(mean, mean))


def entities(model: PathModel, e) -> list[tuple[str, str, str, float]]:
    """(kind, a, b, value) of one estimate: paths, total and specific indirect effects, loadings,
    weights and R2."""
    t = e.tables
    out = [("path", r[0], r[1], r[2]) for r in t.inner_model()]
    indirect, total = powers(t.inner.paths)
    for i, b in enumerate(t.lvs):
        for j, a in enumerate(t.lvs):
            if i != j and (total[i, j] or indirect[i, j]):
                out.append(("total", a, b, float(total[i, j])))
                if indirect[i, j]:
                    out.append(("total_indirect", a, b, float(indirect[i, j])))
    out += [("indirect", r[0], " -> ".join([r[0], *r[2], r[1]]), r[3]) for r in t.specific_indirect()]
    out += [(kind, r[1], r[0], r[c]) for r in t.outer_model() for kind, c in (("loading", 3), ("weight", 2))]
    out += [("r_squared", lv, "", float(t.inner.r2[i])) for i, lv in enumerate(t.lvs) if t.inner.r2[i]]
    return out


@dataclass
class Replicates:
    """draws: (rep, kind, a, b, value), one row per replicate and entity; kind 'failed' where a
    replicate did not converge."""

    point: list[tuple[str, str, str, float]]
    draws: DataFrame
    reps: int

    def counts(self) -> tuple[int, int]:
        """(completed, failed) replicates."""
        failed = self.draws.filter("kind = 'failed'").count()
        return self.reps - failed, failed

    def specific_indirect(self, source: str | None = None, target: str | None = None, through: Sequence[str] = (), alpha: float = 0.05, flip: bool = False) -> DataFrame:
        """The summary of the specific indirect effects between two constructs; ``through`` asks for the
        chain over exactly these. Raises where no chain fits."""
        def fits(kind: str, a: str, chain: str) -> bool:
            nodes = chain.split(" -> ")
            return kind == "indirect" and source in (None, nodes[0]) and target in (None, nodes[-1]) and (not through or list(through) == nodes[1:-1])

        wanted = [p for p in self.point if fits(*p[:3])]
        if not wanted:
            raise ValueError("no specific indirect effect between these constructs")
        chains = [p[2] for p in wanted]
        return summary(Replicates(wanted, self.draws.filter((F.col("kind") == "failed") | F.col("b").isin(chains)), self.reps), alpha, flip)


def bootstrap(fit: FittedModel, row_id: str, reps: int = 5000, seed: int = 42) -> Replicates:
    """Bootstrap of a fit made with ``keep=[row_id]``; ids must differ, equal ids get equal weights.

    ORD and NOM indicators take part by the dummies of their categories; a category that a replicate
    does not draw is left out of it."""
    if reps < 2:
        raise ValueError("at least 2 replicates")
    x = fit.prepared.extended
    m, levels = x.moments, x.levels
    for name, found in levels.items():
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"{name} has more than {MAX_CATEGORIES} categories: a replicate would hold {MAX_CATEGORIES}^2 numbers")
    data = fit.prepared.wide([row_id]).withColumn("_h", F.xxhash64(F.col(f"`{row_id}`")))
    if m.n < 10:
        raise ValueError("a bootstrap needs at least 10 rows")
    names, centre = list(m.names), m.mean.copy()
    parts = replicate_sums(data, "_h", names, centre, reps, seed)
    model, scheme, tolerance, iterations = fit.model, fit.scheme, fit.tolerance, fit.iterations

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.frombuffer(d) for d in pdf["data"]], axis=0)
        block = int(pdf["block"].iloc[0])
        per = data.reshape(-1, 1 + len(names) + len(names) * (len(names) + 1) // 2)
        rows = []
        for i, sums in enumerate(per):
            rep = block * REP_BLOCK + i
            try:
                e = estimate(model, Extended(sums_to_moments(names, centre, sums), levels).present(), scheme, tolerance, iterations)
                rows += [(rep, *r) for r in entities(model, e)]
            except Exception as why:  # noqa: BLE001  a replicate may be degenerate; it is reported
                rows.append((rep, "failed", type(why).__name__, "", float("nan")))
        return pd.DataFrame(rows, columns=["rep", "kind", "a", "b", "value"])

    draws = parts.groupBy("block").applyInPandas(solve, "rep int, kind string, a string, b string, value double")
    return Replicates(entities(model, fit.estimate), draws, reps)


def bias_corrected(v: np.ndarray, original: float, alpha: float) -> list[float]:
    """Limits shifted by the share of draws below the original; plain percentiles where no draw, or
    every draw, lies below it."""
    share, sides = float((v < original).mean()), (alpha / 2, 1 - alpha / 2)
    if 0 < share < 1:
        sides = tuple(normal_cdf(2 * normal_ppf(share) + normal_ppf(q)) for q in sides)
    return [float(x) for x in np.quantile(v, sides)]


def summary(r: Replicates, alpha: float = 0.05, flip: bool = False, min_success: float = 0.1) -> DataFrame:
    """One row per entity: original, mean, std_error, t, percentile and bias-corrected intervals, normal
    and bootstrap p-values, and the number of valid draws.

    flip: a draw that lies nearer to the original with its sign turned is turned. The quantiles are
    exact. Raises where fewer than max(2, min_success x reps) replicates succeeded.
    """
    spark = r.draws.sparkSession
    good = r.draws.filter("kind <> 'failed'")
    point = spark.createDataFrame(r.point, "kind string, a string, b string, original double")
    x = good.join(F.broadcast(point), ["kind", "a", "b"])  # as many rows as the model has entities
    value = F.col("value")
    if flip:
        value = F.when(F.abs(value + F.col("original")) < F.abs(value - F.col("original")), -value).otherwise(value)
    x = x.withColumn("v", value)
    # all replicates of one entity: reps numbers
    stats = x.groupBy("kind", "a", "b", "original").agg(
        F.count("v").alias("valid"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std_error"),
        F.sort_array(F.collect_list("v")).alias("_all"),
    )
    low, high = alpha / 2, 1 - alpha / 2
    least = max(2, min_success * r.reps)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                v = np.asarray(row[7] if len(row) > 7 else row[-1], dtype=float)
                n, original, mean, se = len(v), row.original, row.mean, row.std_error
                if n < least:
                    raise ValueError(f"only {n} of the replicates succeeded")
                t = original / se if se and se > 0 else float("nan")
                bc = bias_corrected(v, original, alpha)
                p_boot = (int((np.abs(v - mean) >= abs(original)).sum()) + 1) / (n + 1) if original else float("nan")
                out.append((row.kind, row.a, row.b, original, mean, se, t, normal_two_sided(t), *np.quantile(v, [low, high]), *bc, p_boot, n))
            yield pd.DataFrame(out, columns=names)

    names = "kind a b original boot_mean se t p_value ci_percentile_lower ci_percentile_upper ci_bc_lower ci_bc_upper p_value_bootstrap valid".split()
    schema = ", ".join(f"{n} {'string' if n in ('kind', 'a', 'b') else 'bigint' if n == 'valid' else 'double'}" for n in names)
    return stats.mapInPandas(finish, schema)


# The six tables of an inference report, the kind of entity in each and its id columns.
INFERENCE = {
    "pathCoefficients": ("path", ("source", "target")),
    "outerLoadings": ("loading", ("lv", "indicator")),
    "outerWeights": ("weight", ("lv", "indicator")),
    "specificIndirectEffects": ("indirect", ("source", "via")),
    "totalIndirectEffects": ("total_indirect", ("source", "target")),
    "totalEffects": ("total", ("source", "target")),
}


def inference(r: Replicates, alpha: float = 0.05) -> dict[str, DataFrame]:
    """Six tables with original, mean, std_error, t_value, the bootstrap p_value and both intervals.
    ``via`` names the whole chain of a specific indirect effect."""
    s = summary(r, alpha, flip=True)
    out = {}
    for name, (kind, ids) in INFERENCE.items():
        out[name] = s.filter(F.col("kind") == kind).select(
            F.col("a").alias(ids[0]), F.col("b").alias(ids[1]), "original", F.col("boot_mean").alias("mean"), F.col("se").alias("std_error"),
            F.col("t").alias("t_value"), F.col("p_value_bootstrap").alias("p_value"), F.col("ci_percentile_lower").alias("ci_percentile_2_5"), F.col("ci_percentile_upper").alias("ci_percentile_97_5"),
            F.col("ci_bc_lower").alias("ci_bc_2_5"), F.col("ci_bc_upper").alias("ci_bc_97_5"),
        )
    return out


def henseler_p(a: Sequence[float], b: Sequence[float]) -> float:
    """Share of pairs of draws in which b lies above a, in O((m + n) log n)."""
    a, b = np.sort(np.asarray(a, dtype=float)), np.asarray(b, dtype=float)
    return float(np.searchsorted(a, b, side="left").sum() / (len(a) * len(b)))


def parametric_t(x: float, y: float, se_x: float, se_y: float, n_x: float, n_y: float) -> tuple[float, float, float]:
    """(t, df, p) with the pooled standard error of two bootstraps."""
    df = n_x + n_y - 2
    pooled = np.sqrt(((n_x - 1) ** 2 / df) * se_x**2 + ((n_y - 1) ** 2 / df) * se_y**2) * np.sqrt(1 / n_x + 1 / n_y)
    t = float((x - y) / pooled) if pooled > 0 else float("nan")
    return t, df, t_two_sided(t, df)


def welch_t(x: float, y: float, se_x: float, se_y: float, n_x: float, n_y: float) -> tuple[float, float, float]:
    vx, vy = (n_x - 1) / n_x * se_x**2, (n_y - 1) / n_y * se_y**2
    if vx + vy <= 0:
        return float("nan"), float("nan"), float("nan")
    df = (vx + vy) ** 2 / (vx**2 / (n_x - 1) + vy**2 / (n_y - 1))
    t = float((x - y) / np.sqrt(vx + vy))
    return t, float(df), t_two_sided(t, df)


__all__ = ["Replicates", "Scheme", "bootstrap", "henseler_p", "parametric_t", "summary", "welch_t"]
