"""Fitting a path model to a Spark DataFrame.

    model = PathModel.of(Paths([("IMAG", "SAT")])).with_block("IMAG", Mode.A, "imag1", "imag2") ...
    fit(df, model, Scheme.PATH).path_coefficients().show()

One aggregation gives the column means and the moments; all tables follow from these on the driver, in
matrices of columns x columns. Scores stay a lazy projection of the input.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentspark.kernel.results import SCHEMAS, Consistent, Tables
from latentspark.kernel.weights import Extended, Solution, solve_metric, solve_nonmetric
from latentspark.moments import Moments, category_moments, moments
from latentspark.spec import Block, Indicator, Mode, PathModel, Scale, Scheme

MAX_CATEGORIES = 1_000  # where dummies take part one by one: in group comparisons and bootstraps
MISSING = ("casewise", "mean", "listwise", "complete")


def numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The columns as doubles with NaN and infinities as NULL; text, dates and flags are refused."""
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, T.NumericType):
            raise ValueError(f"{c} is {kind.simpleString()}, not a number")
    out = []
    for c in columns:
        x = f"cast(`{c}` as double)"
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):  # only these have NaN and infinities
            x = f"case when not isnan({x}) and abs({x}) < double('Infinity') then {x} end"
        out.append(F.expr(x).alias(c))
    return df.select(*[F.col(f"`{k}`") for k in keep if k not in columns], *out)


def usable_rows(df: DataFrame, model: PathModel, missing: str, keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns of the rows that ``missing`` leaves, gaps still in them."""
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    names = [i.name for i in model.indicators]
    if missing == "complete":
        return df.select(*[F.col(f"`{k}`") for k in keep if k not in names], *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    x = numbers(df, names, keep)
    if missing == "listwise":
        return x.dropna(subset=names)
    if missing == "casewise":
        for b in model.blocks.values():
            x = x.filter(F.coalesce(*[F.col(f"`{n}`") for n in b.names]).isNotNull())
    return x


def filled_rows(x: DataFrame, names: Sequence[str], means: dict[str, float | None], keep: Sequence[str] = ()) -> DataFrame:
    """``x`` with gaps read as the means; a column without any answer (mean None) leaves no row."""
    if any(means[n] is None for n in names):
        x = x.limit(0)
    filled = [F.coalesce(F.col(f"`{n}`"), F.lit(means[n] or 0.0)).alias(n) for n in names]
    return x.select(*[F.col(f"`{k}`") for k in keep if k not in names], *filled)


def complete_rows(df: DataFrame, model: PathModel, missing: str, keep: Sequence[str] = ()) -> DataFrame:
    """The model's columns without gaps.

    casewise: rows in which some construct has no answer at all are dropped, other gaps become the
    mean of the rows kept. mean: all gaps become the mean of all rows; only rows with a column that
    has no answer anywhere are dropped. listwise: rows with any gap are dropped. complete: the rows
    are known to have no gaps and pass as they are.
    """
    x = usable_rows(df, model, missing, keep)
    if missing in ("listwise", "complete"):
        return x
    names = [i.name for i in model.indicators]
    return filled_rows(x, names, x.agg(*[F.avg(f"`{n}`").alias(n) for n in names]).first().asDict(), keep)


@dataclass(frozen=True)
class Prepared:
    """data: complete rows. extended: their moments, with category dummies where there are any."""

    data: DataFrame
    extended: Extended
    categories: dict[str, list[float]]
    indicators: tuple[str, ...]

    @property
    def moments(self) -> Moments:
        return self.extended.moments

    def wide(self, keep: Sequence[str]) -> DataFrame:
        """``data`` with a dummy column for each category in place of its indicator, and ``keep``."""
        levels = self.extended.levels
        plain = [F.col(f"`{c}`") for c in self.indicators if c not in levels]
        dummies = [F.when(F.col(f"`{m}`") == v, 1.0).otherwise(0.0).alias(name) for m, vs in self.categories.items() for v, name in zip(vs, levels[m])]
        return self.data.select(*[F.col(f"`{k}`") for k in keep], *plain, *dummies)


def prepare(df: DataFrame, model: PathModel, missing: str = "casewise", keep: Sequence[str] = ()) -> Prepared:
    model.check(df.columns)
    columns = [i.name for i in model.indicators]
    named = [i.name for i in model.indicators if i.scale in (Scale.ORD, Scale.NOM)]
    if not named:  # means and moments come from one pass
        x = usable_rows(df, model, missing, keep)
        m = moments(x, columns, gaps="mean")
        means = dict(zip(columns, m.mean.tolist() if m.n else [None] * len(columns)))
        data = filled_rows(x, columns, means, keep) if missing in ("casewise", "mean") else x
        return Prepared(data, Extended(m, {}), {}, tuple(columns))
    data = complete_rows(df, model, missing, keep)
    m, categories = category_moments(data, [c for c in columns if c not in named], named)
    levels = {name: [f"{name}={k}" for k in range(len(found))] for name, found in categories.items()}
    return Prepared(data, Extended(m, levels), categories, tuple(columns))


def looked_up(column: Column, keys: Sequence[float], values: Sequence[float]) -> Column:
    """The value of the key that the column holds, else 0. keys in order."""
    if len(keys) <= 100:
        out = F.lit(0.0)
        for k, v in zip(keys, values):
            out = F.when(column == k, float(v)).otherwise(out)
        return out
    known, said = np.asarray(keys, dtype=float), np.asarray(values, dtype=float)

    def say(x: pd.Series) -> pd.Series:
        at = np.searchsorted(known, x.to_numpy()).clip(max=len(known) - 1)
        return pd.Series(np.where(known[at] == x.to_numpy(), said[at], 0.0))

    return F.pandas_udf(say, "double")(column.cast("double"))


@dataclass
class Estimate:
    """Everything that follows from moments alone: used by fits and by replicates alike. composite:
    input columns x final indicators (identity but for higher-order constructs)."""

    tables: Tables
    composite: np.ndarray
    inputs: list[str]
    input_scale: np.ndarray

    @property
    def solution(self) -> Solution:
        return self.tables.s


def _blocks(model: PathModel, lvs: Sequence[str]) -> list[Block]:
    return [model.blocks[lv] for lv in lvs]


def estimate(model: PathModel, x: Extended, scheme: Scheme = Scheme.CENTROID, tolerance: float = 1e-6, iterations: int = 100) -> Estimate:
    """Weights and tables from moments. Higher-order constructs take a first estimation with their
    parts in the path, whose scores then are their indicators."""
    if tolerance <= 0:
        raise ValueError("tolerance must be above 0")
    iterations = max(iterations, 100)

    def solve(path: pd.DataFrame, blocks: list[Block], ext: Extended) -> Solution:
        if model.metric:
            return solve_metric(path, blocks, ext.moments, model.scaled, scheme, tolerance, iterations)
        scales = {i.scale for b in blocks for i in b.indicators}
        if scales == {Scale.RAW, Scale.NUM}:
            blocks = [replace(b, indicators=tuple(Indicator(i.name, Scale.NUM) for i in b.indicators)) for b in blocks]
        return solve_nonmetric(path, blocks, ext, scheme, tolerance, iterations)

    names = [i.name for i in model.indicators]
    if not model.higher:
        blocks = _blocks(model, model.lvs)
        s = solve(model.path, blocks, x)
        mvs = s.mvs
        scale = np.ones(len(mvs))
        if not x.levels:
            raw = x.moments.select(mvs)
            scale = s.treated.sd / raw.sd
        return Estimate(Tables(s, blocks, model.path.to_numpy()), np.eye(len(mvs)), mvs, scale)
    if x.levels:
        raise ValueError("higher-order constructs need numeric indicators")
    first_path = model.first_stage_path()
    first = solve(first_path, _blocks(model, list(first_path.columns)), x)
    raw = x.moments.select(first.mvs)
    scale = first.treated.sd / raw.sd
    parts = [p for _, lvs in model.higher.values() for p in lvs]
    turn = np.zeros((len(first.mvs), len(parts)))
    for j, p in enumerate(parts):
        k = first.lvs.index(p)
        turn[:, j] = first.weights[:, k] * first.signs[k] * scale
    kept = [n for n in names if any(n in model.blocks[lv].names for lv in model.lvs if lv not in model.higher)]
    pick = np.zeros((len(first.mvs), len(kept)))
    for j, n in enumerate(kept):
        pick[first.mvs.index(n), j] = 1
    composite = np.concatenate([pick, turn], axis=1)
    blocks = []
    for lv in model.lvs:
        if lv in model.higher:
            mode, of = model.higher[lv]
            blocks.append(Block(lv, mode, tuple(Indicator(p, model.default_scale) for p in of)))
        else:
            blocks.append(model.blocks[lv])
    second = Extended(raw.linear([*kept, *parts], composite), {})
    s = solve(model.path, blocks, second)
    at = [second.moments.names.index(m) for m in s.mvs]
    scale2 = s.treated.sd / second.moments.select(s.mvs).sd
    return Estimate(Tables(s, blocks, model.path.to_numpy()), composite[:, at], first.mvs, scale2)


class FittedModel:
    """Tables of one fit as Spark DataFrames with the schemas of kernel.results.SCHEMAS."""

    def __init__(self, prepared: Prepared, model: PathModel, scheme: Scheme, tolerance: float, iterations: int):
        self.prepared, self.model, self.scheme = prepared, model, scheme
        self.tolerance, self.iterations = tolerance, iterations
        self.estimate = estimate(model, prepared.extended, scheme, tolerance, iterations)
        self.tables = self.estimate.tables
        self.spark = prepared.data.sparkSession
        self._consistent: Consistent | None = None

    def _frame(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows], SCHEMAS[name])

    def data(self) -> DataFrame:
        """The rows the fit used, untreated."""
        return self.prepared.data

    def score_columns(self) -> dict[str, Column]:
        """Each construct's score as an expression over ``data()``."""
        e, s = self.estimate, self.estimate.solution
        out = {}
        if self.prepared.extended.levels:
            for k, lv in enumerate(s.lvs):
                total = F.lit(0.0)
                for j, mv in enumerate(s.mvs):
                    if s.weights[j, k]:
                        total = total + self._quantified(mv) * float(s.weights[j, k])
                out[lv] = total
            return out
        mean = self.prepared.moments.select(e.inputs).mean
        turn = e.composite @ (s.weights * s.signs * e.input_scale[:, None])
        for k, lv in enumerate(s.lvs):
            terms = [(F.col(f"`{c}`") - float(m)) * float(w) for c, m, w in zip(e.inputs, mean, turn[:, k]) if w]
            out[lv] = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
        return out

    def _quantified(self, mv: str) -> Column:
        m, s = self.prepared.moments, self.estimate.solution
        j = s.mvs.index(mv)
        sd = s.treated.sd[j]
        if mv in s.quantified:
            values = s.quantified[mv]
            at = m.names.index(self.prepared.extended.levels[mv][0])
            share = m.mean[at : at + len(values)]
            centre = float(share @ values)
            spread = float(np.sqrt(share @ (values - centre) ** 2)) or 1.0
            factor = sd * np.sqrt((m.n - 1) / m.n) / spread
            return looked_up(F.col(f"`{mv}`"), self.prepared.categories[mv], (values - centre) * factor)
        at = m.names.index(mv)
        return (F.col(f"`{mv}`") - float(m.mean[at])) * float(sd / m.sd[at])

    def scores(self, keep: Sequence[str] = ()) -> DataFrame:
        """One row per row used, lazily; ``keep`` names columns passed to ``fit`` to carry along."""
        return self.prepared.data.select(*[F.col(f"`{k}`") for k in keep], *[c.alias(lv) for lv, c in self.score_columns().items()])

    def outer_model(self) -> DataFrame:
        return self._frame("outer_model", self.tables.outer_model())

    def crossloadings(self) -> DataFrame:
        return self._frame("crossloadings", self.tables.crossloadings())

    def inner_model(self) -> DataFrame:
        return self._frame("inner_model", self.tables.inner_model())

    def path_coefficients(self) -> DataFrame:
        return self._frame("path_coefficients", self.tables.path_coefficients())

    def effects(self) -> DataFrame:
        return self._frame("effects", self.tables.effects())

    def inner_summary(self) -> DataFrame:
        return self._frame("inner_summary", self.tables.inner_summary())

    def goodness_of_fit(self) -> float:
        return self.tables.goodness_of_fit()

    def reliability(self) -> DataFrame:
        return self._frame("reliability", self.tables.reliability())

    def unidimensionality(self) -> DataFrame:
        """The former name of ``reliability``."""
        warnings.warn("unidimensionality is now called reliability", DeprecationWarning, stacklevel=2)
        return self.reliability()

    def _matrix(self, cells: dict[tuple[str, str], float], names: Sequence[str]) -> DataFrame:
        """(lv, one column per construct): NULL where the table has no value."""
        rows = [(a, *[None if v is None or v != v else float(v) for v in (cells.get((a, b)) for b in names)]) for a in names]
        return self.spark.createDataFrame(rows, ", ".join(["lv string", *[f"`{n}` double" for n in names]]))

    def htmt_matrix(self, second: bool = False) -> DataFrame:
        """HTMT (or HTMT2) below the diagonal, constructs of reflective blocks in path order."""
        rows = self.tables.htmt2() if second else self.tables.htmt()
        seen = {lv for r in rows for lv in r[:2]}
        return self._matrix({(b, a): v for a, b, v in rows}, [lv for lv in self.tables.lvs if lv in seen])

    def f_squared_matrix(self) -> DataFrame:
        """f2 of the sources (rows) on the targets (columns)."""
        return self._matrix({(r[0], r[1]): r[4] for r in self.tables.f_squared()}, self.tables.lvs)

    def fornell_larcker_matrix(self) -> DataFrame:
        """Roots of the AVE on the diagonal, construct correlations below it."""
        t = self.tables
        cells = {(a, b): t.score_corr[i, j] for i, a in enumerate(t.lvs) for j, b in enumerate(t.lvs) if j < i}
        return self._matrix(cells | {(r[0], r[0]): r[1] for r in t.fornell_larcker()}, t.lvs)

    def htmt(self) -> DataFrame:
        return self._frame("htmt", self.tables.htmt())

    def htmt2(self) -> DataFrame:
        return self._frame("htmt2", self.tables.htmt2())

    def fornell_larcker(self) -> DataFrame:
        return self._frame("fornell_larcker", self.tables.fornell_larcker())

    def scores_correlation(self) -> DataFrame:
        return self._frame("scores_correlation", self.tables.scores_correlation())

    def f_squared(self) -> DataFrame:
        return self._frame("f_squared", self.tables.f_squared())

    def vif(self) -> DataFrame:
        """Of the indicators of each block."""
        return self._frame("vif_items", self.tables.vif_items())

    def vif_inner(self) -> DataFrame:
        return self._frame("vif_inner", self.tables.vif_inner())

    def model_fit(self) -> DataFrame:
        srmr, d_uls = self.tables.fit_indices()
        try:
            gof = self.goodness_of_fit()
        except ValueError:
            gof = float("nan")
        return self._frame("fit_indices", [(srmr, d_uls, gof)])

    def residuals(self) -> DataFrame:
        return self._frame("residuals", self.tables.residual_pairs())

    def specific_indirect_effects(self, source: str | None = None, target: str | None = None, through: Sequence[str] = ()) -> DataFrame:
        return self._frame("specific_indirect", self.tables.specific_indirect(None, source, target, through))

    def plsc(self) -> Consistent:
        if self._consistent is None:
            self._consistent = Consistent(self.tables)
        return self._consistent

    def plsc_summary(self) -> DataFrame:
        return self._frame("plsc_summary", self.plsc().summary())

    def plsc_paths(self) -> DataFrame:
        return self._frame("plsc_paths", self.plsc().paths())

    def plsc_loadings(self) -> DataFrame:
        return self._frame("plsc_loadings", self.plsc().loadings())

    def plsc_correlations(self) -> DataFrame:
        return self._frame("plsc_correlations", self.plsc().correlations())

    def plsc_specific_indirect_effects(self, source: str | None = None, target: str | None = None, through: Sequence[str] = ()) -> DataFrame:
        return self._frame("specific_indirect", self.tables.specific_indirect(self.plsc().inner.paths, source, target, through))

    def plsc_vif_inner(self) -> DataFrame:
        return self._frame("vif_inner", self.plsc().vif_inner())

    def plsc_htmt(self) -> DataFrame:
        """Absolute consistent correlations of different constructs."""
        h, lvs = self.plsc().htmt(), self.tables.lvs
        return self._frame("htmt", [(a, b, float(h[i, j])) for i, a in enumerate(lvs) for j, b in enumerate(lvs) if i < j])

    def plsc_model_fit(self) -> DataFrame:
        return self._frame("fit_indices", [(*self.plsc().fit_indices(), float("nan"))]).drop("goodness_of_fit")

    def plsc_effects(self) -> DataFrame:
        return self._frame("effects", self.tables.effects(self.plsc().inner.paths))


def fit(
    df: DataFrame,
    model: PathModel,
    scheme: Scheme = Scheme.CENTROID,
    tolerance: float = 1e-6,
    iterations: int = 100,
    missing: str = "casewise",
    keep: Sequence[str] = (),
) -> FittedModel:
    """Fits the model. ``keep``: further columns that ``data()`` and ``scores()`` carry along.

    An empty table, or a column without variance, cannot be fitted: NoConvergence or a ValueError.
    """
    return FittedModel(prepare(df, model, missing, keep), model, scheme, tolerance, iterations)


__all__ = ["Estimate", "FittedModel", "Mode", "Prepared", "complete_rows", "estimate", "fit", "numbers", "prepare"]
