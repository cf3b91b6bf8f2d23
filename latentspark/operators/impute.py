"""Filling missing answers with a Chow-Liu dependency tree.

Fields are coded to small integers (a category, or a bin of a numeric scale). One pass over all rows
counts every pair of fields; mutual information and a maximum spanning tree give the dependency tree.
What other records of the same copy, respondent or context answered enters as further leaves of the
field to fill; their tables come from per-group answer counts, so no wide row is ever shuffled for
them. Message passing over the tree, rooted at the missing field, then gives its exact posterior given
everything observed in the row. Only rows with a missing target travel to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentspark.sources import materialise

MAX_BINS = 16
MAX_LABELS = 256  # a field with more labels is evidence by hashed label; a target must have fewer
SMOOTHING = 0.5
BROADCAST_BYTES = 2_000_000  # of what the groups of a kind say, sent to every task; more is joined by key


@dataclass(frozen=True)
class Field:
    """A column to model. ``labels``: categories in order; else a whole-number scale low..high.

    ``read`` turns the raw column into its label (string) or number, NULL where there is no answer.
    """

    name: str
    low: int = 0
    high: int = 0
    labels: tuple[str, ...] = ()
    read: object = None

    @property
    def bins(self) -> int:
        return min(len(self.labels), MAX_LABELS) or min(MAX_BINS, self.high - self.low + 1)

    def code(self, raw: Column) -> Column:
        """0 .. bins-1, or NULL."""
        value = self.read(raw) if self.read is not None else raw
        if len(self.labels) > MAX_LABELS:
            return F.pmod(F.xxhash64(value.cast("string")), F.lit(MAX_LABELS)).cast("int")
        if self.labels:
            pos = F.array_position(F.array(*[F.lit(x) for x in self.labels]), value.cast("string"))
            return F.when(pos > 0, pos.cast("int") - 1)
        number = value.cast("double")
        span = self.high - self.low + 1
        return F.when(number.between(self.low, self.high), F.floor((number - self.low) * self.bins / span).cast("int"))

    def value(self, code: int) -> str:
        """The label, or the median whole number of the bin."""
        if self.labels:
            return self.labels[code]
        span = self.high - self.low + 1
        inside = [v for v in range(self.low, self.high + 1) if (v - self.low) * self.bins // span == code]
        return str(inside[(len(inside) - 1) // 2])


@dataclass(frozen=True)
class FillSpec:
    """id: unique row key. groups: name -> key columns whose other records are evidence, the first
    being the one whose unanimous answer is taken as it is (``known_from``)."""

    row_id: str
    fields: tuple[Field, ...]
    targets: tuple[str, ...]
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    known_from: str = ""
    known_targets: tuple[str, ...] = ()


@dataclass
class Tree:
    """Chow-Liu tree: per-field marginals and, per edge, joint tables with smoothing."""

    names: list[str]
    bins: list[int]
    edges: list[tuple[int, int]]
    joint: dict[tuple[int, int], np.ndarray]
    marginal: list[np.ndarray]
    leaves: dict[tuple[str, str], np.ndarray]  # (target, group) -> P(leaf | target)


def _coded(df: DataFrame, spec: FillSpec) -> DataFrame:
    keys = sorted({k for ks in spec.groups.values() for k in ks})
    return df.select(
        F.col(f"`{spec.row_id}`").alias("_id"),
        *[F.col(f"`{k}`").alias(f"_k_{k}") for k in keys],
        *[f.code(F.col(f"`{f.name}`")).alias(f"_f{i}") for i, f in enumerate(spec.fields)],
    )


def pair_counts(coded: DataFrame, bins: Sequence[int]) -> dict[tuple[int, int], np.ndarray]:
    """Joint counts of every pair of fields over rows where both are answered.

    Each task sends one number per table cell (pairs x bins^2, fixed by the fields, not by the
    rows); the sums are made before anything reaches the driver.
    """
    pairs = list(combinations(range(len(bins)), 2))
    starts = np.concatenate([[0], np.cumsum([bins[a] * bins[b] for a, b in pairs])]).astype(int)
    cols = [f"_f{i}" for i in range(len(bins))]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(starts[-1], dtype=np.int64)
        for b in batches:
            # one spare code per field takes the missing answers
            codes = [np.where(b[c].isna(), bins[i], b[c].fillna(0)).astype(np.int64) for i, c in enumerate(cols)]
            for k, (x, y) in enumerate(pairs):
                table = np.bincount(codes[x] * (bins[y] + 1) + codes[y], minlength=(bins[x] + 1) * (bins[y] + 1))
                total[starts[k] : starts[k + 1]] += table.reshape(bins[x] + 1, bins[y] + 1)[:-1, :-1].ravel()
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells.astype(np.int32), "n": total[cells]})

    sums = coded.select(*cols).mapInPandas(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(starts[-1])
    for cell, n in sums.collect():  # at most pairs x bins^2 cells
        flat[cell] = n
    return {p: flat[starts[k] : starts[k + 1]].reshape(bins[p[0]], bins[p[1]]) for k, p in enumerate(pairs)}


def mutual_information(table: np.ndarray) -> float:
    """Of a joint count table, in nats; 0 for an empty one."""
    n = table.sum()
    if n <= 0:
        return 0.0
    p = table / n
    outer = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    seen = p > 0
    return float((p[seen] * np.log(p[seen] / outer[seen])).sum())


def chow_liu(counts: dict[tuple[int, int], np.ndarray], n: int) -> list[tuple[int, int]]:
    """Maximum spanning tree by mutual information (Prim); ties go to the lower field numbers."""
    mi = {p: mutual_information(t) for p, t in counts.items()}
    inside, edges = {0}, []
    while len(inside) < n:
        a, b = max(
            ((i, j) for i in inside for j in range(n) if j not in inside),
            key=lambda e: (mi[min(e), max(e)], -e[0], -e[1]),
        )
        edges.append((a, b))
        inside.add(b)
    return edges


def _group_counts(coded: DataFrame, spec: FillSpec, group: str) -> DataFrame:
    """Answer counts of each target per group key; partial sums are made before the shuffle."""
    keys = [f"_k_{k}" for k in spec.groups[group]]
    index = {f.name: i for i, f in enumerate(spec.fields)}
    aggs = []
    for t in spec.targets:
        i = index[t]
        tallies = [F.count(F.when(F.col(f"_f{i}") == k, 1)) for k in range(spec.fields[i].bins)]
        aggs.append(F.array(*tallies).alias(f"_c_{t}"))
    known = coded
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(*aggs)


def _summary(counts: Column, target: Field) -> Column:
    """The code that stands for a group: its mode (lowest on ties), or its mean for numbers."""
    if target.labels:
        best = F.array_position(counts, F.array_max(counts)).cast("int") - 1
    else:
        bins = F.sequence(F.lit(0), F.lit(target.bins - 1))
        zero = F.lit(0).cast("bigint")
        total = F.aggregate(F.zip_with(counts, bins, lambda c, k: c * k), zero, lambda a, x: a + x)
        best = F.round(F.try_divide(total, F.aggregate(counts, zero, lambda a, x: a + x))).cast("int")
    return F.when(F.array_max(counts) > 0, best)


def _unanimous(counts: Column) -> Column:
    """The code of the one answer that all of a group give, or NULL."""
    only = F.array_position(counts, F.array_max(counts)).cast("int") - 1
    return F.when(F.size(F.filter(counts, lambda x: x > 0)) == 1, only)


def _leaf_tables(groups: DataFrame, spec: FillSpec) -> dict[str, np.ndarray]:
    """Per target: counts of (own answer, what the other records of the group say)."""
    index = {f.name: f for f in spec.fields}
    parts = None
    for t in spec.targets:
        f = index[t]
        one = groups.select(F.col(f"_c_{t}").alias("c"), F.posexplode(f"_c_{t}").alias("own", "times")).filter("times > 0")
        others = F.transform(F.col("c"), lambda x, k: x - F.when(k == F.col("own"), 1).otherwise(0))
        one = one.select(F.lit(t).alias("t"), "own", _summary(others, f).alias("leaf"), "times").filter("leaf IS NOT NULL")
        one = one.groupBy("t", "own", "leaf").agg(F.sum("times").alias("n"))
        parts = one if parts is None else parts.unionByName(one)
    out = {t: np.zeros((index[t].bins, index[t].bins)) for t in spec.targets}
    for t, own, leaf, n in parts.collect():  # at most targets x bins^2 rows
        out[t][own, leaf] = n
    return out


def fit_tree(coded: DataFrame, spec: FillSpec, groups: dict[str, DataFrame]) -> Tree:
    bins = [f.bins for f in spec.fields]
    counts = pair_counts(coded, bins)
    edges = chow_liu(counts, len(bins))
    joint, marginal = {}, [np.full(b, SMOOTHING) for b in bins]
    for (a, b), t in counts.items():
        # a field's marginal: from its best-filled pair
        if t.sum() + SMOOTHING > marginal[a].sum():
            marginal[a] = t.sum(1) + SMOOTHING
        if t.sum() + SMOOTHING > marginal[b].sum():
            marginal[b] = t.sum(0) + SMOOTHING
    for a, b in edges:
        t = counts[min(a, b), max(a, b)]
        joint[a, b] = (t if a < b else t.T) + SMOOTHING
    leaves = {}
    for g, table in groups.items():
        for t, own in _leaf_tables(table, spec).items():
            p = own + SMOOTHING
            leaves[t, g] = p / p.sum(1, keepdims=True)
    return Tree([f.name for f in spec.fields], bins, edges, joint, [m / m.sum() for m in marginal], leaves)


def posterior(tree: Tree, codes: np.ndarray, root: int, leaf_codes: dict[str, np.ndarray]) -> np.ndarray:
    """P(root | observed) for rows of codes (-1: missing), by one upward pass of messages."""
    n = len(codes)
    near: dict[int, list[int]] = {i: [] for i in range(len(tree.bins))}
    for a, b in tree.edges:
        near[a].append(b)
        near[b].append(a)
    order, parent = [root], {root: -1}
    for v in order:
        for u in near[v]:
            if u != parent[v]:
                parent[u] = v
                order.append(u)
    belief = {}
    for v in reversed(order):
        if v not in belief:
            belief[v] = np.ones((n, tree.bins[v]))
        if v == root:
            break
        seen = codes[:, v] >= 0
        evidence = belief[v]
        evidence[seen] = np.eye(tree.bins[v])[codes[seen, v]]
        p = parent[v]
        table = tree.joint[p, v] if (p, v) in tree.joint else tree.joint[v, p].T
        message = evidence @ (table / table.sum(1, keepdims=True)).T
        message /= message.sum(1, keepdims=True)
        belief.setdefault(p, np.ones((n, tree.bins[p])))
        belief[p] = belief[p] * message
        belief[p] /= belief[p].sum(1, keepdims=True)
    out = np.log(tree.marginal[root] + 1e-300) + np.log(belief[root] + 1e-300)
    for g, leaf in leaf_codes.items():
        seen = leaf >= 0
        out[seen] += np.log(tree.leaves[tree.names[root], g][:, leaf[seen]].T)
    out = np.exp(out - out.max(1, keepdims=True))
    return out / out.sum(1, keepdims=True)


def with_certain(post: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The posterior once the root's value is known for certain (-1: it is not)."""
    out, sure = post.copy(), known >= 0
    out[sure] = np.maximum(out[sure], 1e-300) * np.eye(post.shape[1])[known[sure]]
    return out / out.sum(1, keepdims=True)


def decode(post: np.ndarray, labels: bool) -> np.ndarray:
    """The mode of labels (first on ties), the median bin of numbers."""
    return post.argmax(1) if labels else (np.cumsum(post, 1) < 0.5 - 1e-12).sum(1)


def filled_cells(df: DataFrame, spec: FillSpec) -> DataFrame:
    """One row per missing target cell: (row_id, fld, value, method, confidence, known_fill, tree_value,
    tree_confidence).

    value: the fill as text, never NULL: decoded from the tree's posterior, which what all answered
    records of ``known_from`` agree on enters as certain evidence. method: 'known' where there is such
    evidence, else 'tree'. known_fill: the value decoded from certain evidence, '' without it.
    tree_value, tree_confidence: what the tree says without certain evidence.

    Defined results: a field without any answer is filled from the smoothed (uniform) tables; NULL
    group keys bring no evidence; repeated rows are filled each by itself; an empty table gives no
    cells; other columns are ignored, whatever their names. Numeric ties go to the lower bin.
    """
    for f in spec.fields:
        if f.name in spec.targets and len(f.labels) > MAX_LABELS:
            raise ValueError(f"{f.name} has more than {MAX_LABELS} labels to choose from")
    coded = _coded(df, spec)
    groups = {g: materialise(_group_counts(coded, spec, g), "groups") for g in spec.groups}
    tree = fit_tree(coded, spec, groups)
    index = {f.name: i for i, f in enumerate(spec.fields)}

    gap = F.lit(False)
    for t in spec.targets:
        gap = gap | F.col(f"_f{index[t]}").isNull()
    todo = coded.filter(gap)
    known_here = [t for t in spec.targets if t in spec.known_targets and spec.known_from]
    for g, counts in groups.items():
        keys = [f"_k_{k}" for k in spec.groups[g]]
        # the codes that a group stands for, not its counts, go to the rows
        says = [_summary(F.col(f"_c_{t}"), spec.fields[index[t]]).alias(f"_l_{g}_{t}") for t in spec.targets]
        if g == spec.known_from:
            says += [_unanimous(F.col(f"_c_{t}")).alias(f"_known_{t}") for t in known_here]
        other = counts.select(*[F.col(k).alias(f"_o{k}") for k in keys], *says)
        match = F.lit(True)
        for k in keys:
            match = match & (F.col(k) == F.col(f"_o{k}"))
        if counts.count() * 8 * (len(other.columns) + 4) <= BROADCAST_BYTES:  # of a written table
            other = F.broadcast(other)
        todo = todo.join(other, match, "left").drop(*[f"_o{k}" for k in keys])
    leaf_cols = [f"_l_{g}_{t}" for t in spec.targets for g in spec.groups]
    known_cols = [F.col(f"_known_{t}") if t in known_here else F.lit(None).cast("int").alias(f"_known_{t}") for t in spec.targets]
    cols = [f"_f{i}" for i in range(len(spec.fields))]
    todo = todo.select("_id", *cols, *leaf_cols, *known_cols)
    fields, targets, names = spec.fields, spec.targets, list(spec.groups)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = np.stack([b[c].fillna(-1).to_numpy(dtype=np.int64) for c in cols], axis=1)
            for t in targets:
                r = index[t]
                rows = np.flatnonzero(codes[:, r] < 0)
                if not len(rows):
                    continue
                leaf = {g: b[f"_l_{g}_{t}"].fillna(-1).to_numpy(dtype=np.int64)[rows] for g in names}
                post = posterior(tree, codes[rows], r, leaf)
                known = b[f"_known_{t}"].fillna(-1).to_numpy(dtype=np.int64)[rows]
                sure = with_certain(post, known)
                tree_says, says = decode(post, bool(fields[r].labels)), decode(sure, bool(fields[r].labels))
                at = np.arange(len(rows))
                value = [fields[r].value(int(k)) for k in says]
                yield pd.DataFrame(
                    {
                        "row_id": b["_id"].to_numpy()[rows],
                        "fld": t,
                        "value": value,
                        "method": np.where(known >= 0, "known", "tree"),
                        "confidence": sure[at, says],
                        "known_fill": [v if k >= 0 else "" for v, k in zip(value, known)],
                        "tree_value": [fields[r].value(int(k)) for k in tree_says],
                        "tree_confidence": post[at, tree_says],
                    }
                )

    out = T.StructType(
        [
            T.StructField("row_id", df.schema[spec.row_id].dataType),
            *[T.StructField(c, T.StringType()) for c in ("fld", "value", "method")],
            T.StructField("confidence", T.DoubleType()),
            T.StructField("known_fill", T.StringType()),
            T.StructField("tree_value", T.StringType()),
            T.StructField("tree_confidence", T.DoubleType()),
        ]
    )
    return todo.mapInPandas(fill, out)


def fill_missing(df: DataFrame, spec: FillSpec) -> DataFrame:
    """``df`` with the target fields complete (as text) and ``<field>_filled`` marks.

    The answered cells come out as the label or number they were read as. Rows without a gap pass as
    they are: only rows with one are joined with their fills.
    """
    index = {f.name: f for f in spec.fields}
    gap = F.lit(False)
    for t in spec.targets:
        gap = gap | index[t].code(F.col(f"`{t}`")).isNull()
    wide = filled_cells(df, spec).groupBy(F.col("row_id").alias("_rid")).agg(
        *[F.max(F.when(F.col("fld") == t, F.col("value"))).alias(f"_v_{t}") for t in spec.targets]
    )

    def shown(rows: DataFrame, filled: bool) -> DataFrame:
        out = []
        for name in df.columns:
            c = F.col(f"`{name}`")
            if name in spec.targets:
                f = index[name]
                own = F.when(f.code(c).isNotNull(), (f.read(c) if f.read is not None else c).cast("string"))
                out += [F.coalesce(own, F.col(f"_v_{name}")).alias(name) if filled else own.alias(name), own.isNull().alias(f"{name}_filled")]
            else:
                out.append(c)
        return rows.select(*out)

    gaps = df.filter(gap).join(wide, F.col(f"`{spec.row_id}`") == F.col("_rid"), "left")
    return shown(df.filter(~gap), False).unionByName(shown(gaps, True))


def held_out(df: DataFrame, spec: FillSpec, one_in: int = 10) -> DataFrame:
    """(fld, cells, tree_right, mode_right, tree_error, mode_error): of each target, one answered cell in
    ``one_in`` (by hash) is hidden and filled from all others: how often the tree's own value and the
    column's commonest (for numbers: median) answer are right, and how far off they are on average
    (numbers only). The unanimous answers of ``known_from`` play no part."""
    index = {f.name: f for f in spec.fields}
    hidden = df
    truth = None
    for t in spec.targets:
        f = index[t]
        c = F.col(f"`{t}`")
        out = (F.pmod(F.xxhash64(F.lit(t), F.col(f"`{spec.row_id}`")), F.lit(one_in)) == 0) & f.code(c).isNotNull()
        read = (f.read(c) if f.read is not None else c).cast("string")
        one = df.filter(out).select(F.col(f"`{spec.row_id}`").alias("row_id"), F.lit(t).alias("fld"), read.alias("truth"))
        truth = one if truth is None else truth.unionByName(one)
        kind = df.schema[t].dataType
        hidden = hidden.withColumn(t, F.when(~F.coalesce(out, F.lit(False)), c).cast(kind))
    usual = None
    for t in spec.targets:
        f = index[t]
        c = F.when(f.code(F.col(f"`{t}`")).isNotNull(), (f.read(F.col(f"`{t}`")) if f.read is not None else F.col(f"`{t}`")))
        common = F.mode(c.cast("string")) if f.labels else F.percentile_approx(c.cast("double"), 0.5, 10_000).cast("int").cast("string")
        one = hidden.agg(common.alias("usual")).select(F.lit(t).alias("fld"), "usual")
        usual = one if usual is None else usual.unionByName(one)
    cells = filled_cells(hidden, spec).select("row_id", "fld", "tree_value")
    x = truth.join(cells, ["row_id", "fld"]).join(F.broadcast(usual), "fld")  # a row per target
    off = lambda c: F.avg(F.abs(F.col(c).try_cast("double") - F.col("truth").try_cast("double")))
    right = lambda c: F.avg(F.when(F.col(c) == F.col("truth"), 1.0).otherwise(0.0))
    return x.groupBy("fld").agg(
        F.count(F.lit(1)).alias("cells"), right("tree_value").alias("tree_right"), right("usual").alias("mode_right"), off("tree_value").alias("tree_error"), off("usual").alias("mode_error")
    )
