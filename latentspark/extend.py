"""Models built on other models: interaction terms and two-stage higher-order constructs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.model import FittedModel, fit
from latentspark.spec import Mode, PathModel, Paths, Scheme


@dataclass
class Moderation:
    """base: the fit without the interaction. refit: with it. name: of the interaction construct."""

    base: FittedModel
    refit: FittedModel
    name: str
    target: str

    def interaction_effect(self) -> DataFrame:
        return self.refit.inner_model().filter((F.col("source") == self.name) & (F.col("target") == self.target))


def _metric_copy(model: PathModel, path: Paths, without: Sequence[str] = ()) -> PathModel:
    out = PathModel.of(path, model.scaled)
    for b in model.blocks.values():
        if b.lv not in without:
            out = out.with_block(b.lv, b.mode, *b.names)
    return out


def moderate(df: DataFrame, model: PathModel, predictor: str, moderator: str, target: str, scheme: Scheme = Scheme.CENTROID, name: str | None = None, **options) -> Moderation:
    """Two stages: the product of the scores of predictor and moderator becomes the single indicator
    of a construct with a path to the target. The second stage is metric. The product is an
    expression over the rows of the first stage: no join and no further pass."""
    for lv in (predictor, moderator, target):
        if lv not in model.lvs:
            raise ValueError(f"{lv} is not a construct of the model")
    if predictor == moderator or target in (predictor, moderator):
        raise ValueError("predictor, moderator and target must differ")
    if not model.path.loc[target].any():
        raise ValueError(f"{target} has no incoming paths")
    name = name or f"{predictor}_x_{moderator}"
    indicator = f"{name}__ind"
    if name in model.lvs or indicator in df.columns:
        raise ValueError(f"{name} or {indicator} is taken")
    base = fit(df, model, scheme, **options)
    scores = base.score_columns()
    rows = base.data().withColumn(indicator, scores[predictor] * scores[moderator])
    edges = [(s, t) for t in model.lvs for s in model.lvs if model.path.loc[t, s]]
    extended = _metric_copy(model, Paths([*edges, (name, target)])).with_block(name, Mode.A, indicator)
    return Moderation(base, fit(rows, extended, scheme, **(options | {"missing": "complete"})), name, target)


@dataclass
class HigherOrder:
    """base: first-stage fit with the parts. refit: second stage with their scores as indicators."""

    base: FittedModel
    refit: FittedModel
    name: str
    parts: list[str]
    indicators: list[str]

    def type(self) -> str:
        """I to IV: modes of the parts, then of the construct."""
        first = {self.base.model.blocks[p].mode for p in self.parts}
        second = self.refit.model.blocks[self.name].mode
        if len(first) > 1:
            return "mixed"
        kind = {(Mode.A, Mode.A): "I", (Mode.A, Mode.B): "II", (Mode.B, Mode.A): "III", (Mode.B, Mode.B): "IV"}
        return kind[first.pop(), second]

    def summary(self) -> DataFrame:
        """(first_order, weight, loading, stage1_r_squared)."""
        outer = {r[0]: r for r in self.refit.tables.outer_model()}
        t = self.base.tables
        rows = [(p, outer[i][2], outer[i][3], float(t.inner.r2[t.lvs.index(p)])) for p, i in zip(self.parts, self.indicators)]
        return self.base.spark.createDataFrame(rows, "first_order string, weight double, loading double, stage1_r_squared double")


def higher_order(base: FittedModel, name: str, parts: Sequence[str], mode: Mode, structure: Paths, **options) -> HigherOrder:
    """Disjoint two-stage construct: scores of ``parts`` become its indicators ``name__part`` in the
    paths of ``structure``, whose other constructs keep their blocks. The second stage is metric."""
    model = base.model
    if len(parts) < 2 or len(set(parts)) < len(parts):
        raise ValueError("a higher-order construct needs at least two different parts")
    if set(parts) - set(model.lvs):
        raise ValueError(f"not constructs of the model: {sorted(set(parts) - set(model.lvs))}")
    nodes = structure.order()
    if name not in nodes or name in model.lvs:
        raise ValueError(f"{name} must be in the structure and not in the first stage")
    if set(parts) & set(nodes):
        raise ValueError("the parts of a higher-order construct may not be in its structure")
    if set(nodes) - {name} - set(model.lvs):
        raise ValueError(f"no blocks for {sorted(set(nodes) - {name} - set(model.lvs))}")
    indicators = [f"{name}__{p}" for p in parts]
    scores = base.score_columns()
    rows = base.data().select("*", *[scores[p].alias(i) for p, i in zip(parts, indicators)])
    second = PathModel.of(structure, model.scaled)
    for lv in nodes:
        second = second.with_block(lv, mode, *indicators) if lv == name else second.with_block(lv, model.blocks[lv].mode, *model.blocks[lv].names)
    return HigherOrder(base, fit(rows, second, base.scheme, **(options | {"missing": "complete"})), name, list(parts), indicators)
