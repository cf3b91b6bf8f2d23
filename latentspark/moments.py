"""Means and covariances by one distributed aggregation: all that a metric fit needs of the rows.

Every task reduces its rows to counts, sums and cross products about a centre of its own, and tasks are
merged by moving these to a common centre, which loses no digits to large means. Counts and sums are
kept for every pair of columns, so that the moments of data whose gaps are filled with the columns'
means come from the same single pass that finds these means. A task sends O(columns^2) numbers per
group, however many rows it has; FAN_IN tasks are merged at a time, so no single task and no driver
step receives a row from every other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 256  # tasks whose results are merged together


def task_group() -> int:
    """Which FAN_IN tasks this one is merged with; 0 outside of a task."""
    context = TaskContext.get()
    return context.partitionId() // FAN_IN if context is not None else 0


@dataclass(frozen=True)
class Moments:
    """n, means and M2 (sums of products about the means) of the named columns. n may be a sum of
    replicate weights. m2 is an array, or the Gram matrix of numbers and category dummies."""

    names: tuple[str, ...]
    n: float
    mean: np.ndarray
    m2: np.ndarray

    @property
    def cov(self) -> np.ndarray:
        return self.m2 / (self.n - 1)

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(self.cov.diagonal())

    @property
    def corr(self) -> np.ndarray:
        s = self.sd
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.cov / np.outer(s, s)

    def select(self, names: Sequence[str]) -> Moments:
        at = [self.names.index(x) for x in names]
        return Moments(tuple(names), self.n, self.mean[at], self.m2[np.ix_(at, at)])

    def plus(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(self.names, n, self.mean + d * other.n / n, self.m2 + other.m2 + np.outer(d, d) * self.n * other.n / n)

    def minus(self, part: Moments) -> Moments:
        """What is left of these rows without the part's."""
        n = self.n - part.n
        if n <= 0:
            return Moments(self.names, 0.0, np.zeros_like(self.mean), np.zeros_like(self.m2))
        mean = (self.mean * self.n - part.mean * part.n) / n
        d = part.mean - mean
        return Moments(self.names, n, mean, self.m2 - part.m2 - np.outer(d, d) * n * part.n / self.n)

    def linear(self, names: Sequence[str], weights: np.ndarray) -> Moments:
        """Moments of linear combinations (columns x new columns)."""
        return Moments(tuple(names), self.n, self.mean @ weights, weights.T @ self.m2 @ weights)


@dataclass(frozen=True, eq=False)
class Gram:
    """The symmetric matrix [[numbers, sums], [sums', diag(own) + met - outer(root, root)]], held in parts.

    As M2 of numeric columns and category dummies: sums are those of the numbers, about their means, in each
    category; own are the categories' counts; met are the counts of rows that pairs of categories of
    different indicators share, as (first, second, count); root is count / sqrt(n). Categories of one
    indicator never meet, so no square of their number is held."""

    numbers: np.ndarray
    sums: np.ndarray
    own: np.ndarray
    met: tuple[np.ndarray, np.ndarray, np.ndarray]
    root: np.ndarray

    __array_ufunc__ = None  # arrays leave products to __rmatmul__

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        if v.ndim == 2:
            return np.stack([self @ c for c in v.T], axis=1) if v.shape[1] else np.zeros_like(v)
        p, k = len(self.numbers), len(self.own)
        x, y = v[:p], v[p:]
        a, b, count = self.met
        met = np.bincount(a, count * y[b], k) + np.bincount(b, count * y[a], k)
        return np.concatenate([self.numbers @ x + self.sums @ y, x @ self.sums + self.own * y + met - self.root * (self.root @ y)])

    def __rmatmul__(self, v: np.ndarray) -> np.ndarray:
        return (self @ v.T).T

    def __truediv__(self, by: float) -> Gram:
        a, b, count = self.met
        return Gram(self.numbers / by, self.sums / by, self.own / by, (a, b, count / by), self.root / np.sqrt(by))

    def diagonal(self) -> np.ndarray:
        return np.concatenate([self.numbers.diagonal(), self.own - self.root**2])


def of_rows(names: Sequence[str], x: np.ndarray, weights: np.ndarray | None = None) -> Moments:
    n = float(len(x)) if weights is None else float(weights.sum())
    if not n:
        return Moments(tuple(names), 0.0, np.zeros(len(names)), np.zeros((len(names),) * 2))
    mean = x.mean(0) if weights is None else weights @ x / n
    c = x - mean
    return Moments(tuple(names), n, mean, (c if weights is None else c * weights[:, None]).T @ c)


class _Sums:
    """n rows; per pair (i, j), over rows with both answers: their number, the sum of column i and the
    sum of products, columns taken about ``centre``."""

    def __init__(self, n: float, centre: np.ndarray, count: np.ndarray, total: np.ndarray, product: np.ndarray):
        self.n, self.centre, self.count, self.total, self.product = n, centre, count, total, product

    @staticmethod
    def of(x: np.ndarray, centre: np.ndarray | None = None) -> _Sums:
        has = np.isfinite(x)
        if centre is None:
            centre = np.where(has, x, 0.0).sum(0) / np.maximum(has.sum(0), 1)
        y = np.where(has, x - centre, 0.0)
        h = has.astype(float)
        return _Sums(float(len(x)), centre, h.T @ h, y.T @ h, y.T @ y)

    def add(self, o: _Sums) -> None:
        d = o.centre - self.centre
        self.n += o.n
        self.product = self.product + o.product + d[:, None] * o.total.T + d * o.total + np.outer(d, d) * o.count
        self.total = self.total + o.total + d[:, None] * o.count
        self.count = self.count + o.count

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.centre, self.count.ravel(), self.total.ravel(), self.product.ravel()]).tobytes()

    @staticmethod
    def unpack(p: int, data: bytes) -> _Sums:
        v = np.frombuffer(data)
        square = lambda k: v[1 + p + k * p * p : 1 + p + (k + 1) * p * p].reshape(p, p)
        return _Sums(float(v[0]), v[1 : p + 1], square(0), square(1), square(2))

    def moments(self, names: Sequence[str]) -> Moments:
        """Of the rows with gaps filled by the columns' means; no rows where a column has no answer."""
        answered = np.diag(self.count)
        if not self.n or (answered == 0).any():
            return Moments(tuple(names), 0.0, np.zeros(len(names)), np.zeros((len(names),) * 2))
        m = np.diag(self.total) / answered
        m2 = self.product - m[:, None] * self.total.T - m * self.total + np.outer(m, m) * self.count
        return Moments(tuple(names), self.n, self.centre + m, (m2 + m2.T) / 2)


def grouped_moments(df: DataFrame, columns: Sequence[str], keys: dict[str, str] | None = None, gaps: str = "drop") -> dict:
    """Moments per value of a key: {key: Moments}.

    gaps: 'drop' leaves out rows with a NULL, NaN or infinity in any column; 'mean' reads them as the
    mean of the column's answers in the group. keys: {column: ...} names one column of group values
    (text); None gives the single key None. The number of groups must be one that the driver can hold
    times columns^2 numbers.
    """
    columns, p, fill = list(columns), len(columns), gaps == "mean"
    key = next(iter(keys)) if keys else None
    picked = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    k = F.col(f"`{key}`").cast("string") if key else F.lit("")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, _Sums] = {}
        for b in batches:
            x, own = b.iloc[:, 1:].to_numpy(dtype=float), b["k"].to_numpy()
            if not fill:
                whole = np.isfinite(x).all(1)
                x, own = x[whole], own[whole]
            for g in pd.unique(own):
                some = x[own == g] if key else x
                if g in sums:
                    sums[g].add(_Sums.of(some, sums[g].centre))
                else:
                    sums[g] = _Sums.of(some)
        yield pd.DataFrame({"k": list(sums), "part": task_group(), "m": [s.pack() for s in sums.values()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _Sums.unpack(p, pdf["m"].iloc[0])
        for data in pdf["m"].iloc[1:]:
            total.add(_Sums.unpack(p, data))
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "part": pdf["part"].iloc[:1], "m": [total.pack()]})

    schema = "k string, part int, m binary"
    merged = df.select(k.alias("k"), *picked).mapInPandas(run, schema).groupBy("k", "part").applyInPandas(merge, schema)
    out: dict = {}
    for r in sorted(merged.collect(), key=lambda r: (r["k"] or "", r["part"])):  # groups x tasks / FAN_IN rows
        g, s = r["k"] if key else None, _Sums.unpack(p, r["m"])
        if g in out:
            out[g].add(s)
        else:
            out[g] = s
    return {g: s.moments(columns) for g, s in out.items()}


def moments(df: DataFrame, columns: Sequence[str], gaps: str = "drop") -> Moments:
    """Moments of all rows, or of all complete ones (see grouped_moments); n = 0 for none."""
    columns = list(columns)
    found = grouped_moments(df, columns, gaps=gaps)
    p = len(columns)
    return found.get(None, Moments(tuple(columns), 0.0, np.zeros(p), np.zeros((p, p))))


def category_moments(df: DataFrame, numbers: Sequence[str], named: Sequence[str]) -> tuple[Moments, dict[str, list[float]]]:
    """Moments of the numbers and of a dummy for each category of the named columns, and the categories
    in order. The rows must have no gaps.

    One pass counts the categories, sums the numbers in each, and counts the pairs of categories that
    meet. The driver holds these: of a category, a number per numeric column and per category met.
    """
    numbers, named = list(numbers), list(named)
    plain = moments(df, numbers)
    keys = [F.col(f"_c{k}") for k in range(len(named))]
    cells = df.select(
        *[F.col(f"`{m}`").cast("double").alias(f"_c{k}") for k, m in enumerate(named)],
        *[(F.col(f"`{c}`").cast("double") - float(x)).alias(f"_x{i}") for i, (c, x) in enumerate(zip(numbers, plain.mean))],
    )
    sets = [[c] for c in keys] + [[keys[a], keys[b]] for a in range(len(named)) for b in range(a)]
    cells = cells.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_x{i}").alias(f"_x{i}") for i in range(len(numbers))])
    found = cells.toArrow()  # as many as there are categories and pairs that meet
    value = {c: found[c].to_numpy().astype(float) for c in found.column_names}
    has = [~np.isnan(value[f"_c{k}"]) for k in range(len(named))]
    alone = sum(h.astype(int) for h in has) == 1

    categories, first, at, own, sums = {}, [], 0, [], []
    for k, m in enumerate(named):
        rows = np.flatnonzero(has[k] & alone)
        rows = rows[np.argsort(value[f"_c{k}"][rows])]
        categories[m] = value[f"_c{k}"][rows].tolist()
        first.append(at)
        at += len(rows)
        own.append(value["n"][rows])
        sums.append(np.array([value[f"_x{i}"][rows] for i in range(len(numbers))]).reshape(len(numbers), len(rows)))
    met: list[list[np.ndarray]] = [[np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)], [np.zeros(0)]]
    for a in range(len(named)):
        for b in range(a):
            rows = np.flatnonzero(has[a] & has[b])
            for side, k in enumerate((a, b)):
                met[side].append(first[k] + np.searchsorted(categories[named[k]], value[f"_c{k}"][rows]))
            met[2].append(value["n"][rows])
    counts = np.concatenate(own)
    n = float(own[0].sum())
    names = (*numbers, *[f"{m}={i}" for m in named for i in range(len(categories[m]))])
    share = counts / n if n else counts
    gram = Gram(plain.m2, np.concatenate(sums, axis=1), counts, tuple(np.concatenate(x) for x in met), share * np.sqrt(n))
    return Moments(names, n, np.concatenate([plain.mean, share]), gram), categories
