"""Declaring path models: constructs, their indicators and the paths between constructs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum

import numpy as np
import pandas as pd


class Mode(Enum):
    """A: reflective (correlation weights). B: formative (regression weights)."""

    A = "A"
    B = "B"


class Scale(Enum):
    """Measurement level of an indicator; any scale makes the estimation nonmetric."""

    NUM = "num"
    RAW = "raw"
    ORD = "ord"
    NOM = "nom"


class Scheme(Enum):
    """How the inner estimate of a construct weighs its neighbours."""

    CENTROID = "centroid"
    PATH = "path"
    FACTORIAL = "factorial"
    NEWTON = "newton"
    PCA = "pca"


class Paths:
    """Directed edges between constructs. ``order`` does not change the object, so it may be asked
    for any number of times."""

    def __init__(self, edges: Iterable[tuple[str, str]] = ()):
        self.edges: list[tuple[str, str]] = list(edges)

    def add(self, sources: Sequence[str], targets: Sequence[str]) -> Paths:
        if not sources or not targets:
            raise ValueError("sources and targets need at least one entry each")
        if len(sources) != 1 and len(targets) != 1:
            raise ValueError("either sources or targets must have a single entry")
        self.edges += [(s, t) for s in sources for t in targets]
        return self

    def order(self) -> list[str]:
        """Topological order; of several free constructs the one freed last comes first."""
        nodes = list(dict.fromkeys(v for s, t in self.edges for v in (t, s)))
        waiting = {v: sum(t == v for _, t in self.edges) for v in nodes}
        free, out = [v for v in nodes if not waiting[v]], []
        while free:
            v = free.pop()
            out.append(v)
            for s, t in self.edges:
                if s == v:
                    waiting[t] -= 1
                    if not waiting[t]:
                        free.append(t)
        if len(out) < len(nodes):
            raise ValueError("the paths contain a cycle")
        return out

    def matrix(self) -> pd.DataFrame:
        """0/1 matrix with rows as targets and columns as sources, lower triangular."""
        names = self.order()
        m = pd.DataFrame(0, index=names, columns=names)
        for s, t in self.edges:
            m.loc[t, s] = 1
        return m


@dataclass(frozen=True)
class Indicator:
    name: str
    scale: Scale | None = None


@dataclass(frozen=True)
class Block:
    lv: str
    mode: Mode
    indicators: tuple[Indicator, ...]

    @property
    def names(self) -> list[str]:
        return [i.name for i in self.indicators]


@dataclass(frozen=True)
class PathModel:
    """A path model; ``with_*`` methods return extended copies."""

    path: pd.DataFrame
    scaled: bool = True
    default_scale: Scale | None = None
    blocks: dict[str, Block] = field(default_factory=dict)
    higher: dict[str, tuple[Mode, tuple[str, ...]]] = field(default_factory=dict)

    @staticmethod
    def of(path: Paths | pd.DataFrame, scaled: bool = True, default_scale: Scale | None = None) -> PathModel:
        m = path.matrix() if isinstance(path, Paths) else path
        if not isinstance(m, pd.DataFrame):
            raise TypeError("the path must be Paths or a pandas DataFrame")
        if m.shape[0] != m.shape[1]:
            raise ValueError("the path matrix must be square")
        if list(m.index) != list(m.columns):
            raise ValueError("the path matrix must have the same names on both sides")
        v = m.to_numpy()
        if not np.isin(v, (0, 1)).all():
            raise ValueError("the path matrix may only hold 0 and 1")
        if np.triu(v, 1).any():
            raise ValueError("the path matrix must be lower triangular")
        return PathModel(m, scaled, default_scale)

    @property
    def lvs(self) -> list[str]:
        return list(self.path.columns)

    def with_block(self, lv: str, mode: Mode, *indicators: str | Indicator) -> PathModel:
        inside = {x for _, lvs in self.higher.values() for x in lvs}
        if lv not in self.path.columns and lv not in inside:
            raise ValueError(f"{lv} is not in the path, nor in a higher-order construct")
        items = tuple(i if isinstance(i, Indicator) else Indicator(i) for i in indicators)
        items = tuple(i if i.scale is not None else replace(i, scale=self.default_scale) for i in items)
        if not items:
            raise ValueError(f"{lv} has no indicators")
        taken = {n for b in self.blocks.values() if b.lv != lv for n in b.names}
        if taken & {i.name for i in items}:
            raise ValueError(f"an indicator may belong to one construct only: {sorted(taken & {i.name for i in items})}")
        return replace(self, blocks=self.blocks | {lv: Block(lv, mode, items)})

    def with_prefix(self, lv: str, mode: Mode, columns: Iterable[str], prefix: str) -> PathModel:
        names = [c for c in columns if c.startswith(prefix)]
        if not names:
            raise ValueError(f"no column begins with {prefix}")
        return self.with_block(lv, mode, *names)

    def with_higher_order(self, lv: str, mode: Mode, parts: Sequence[str]) -> PathModel:
        if lv not in self.path.columns:
            raise ValueError(f"{lv} is not in the path")
        return replace(self, higher=self.higher | {lv: (mode, tuple(parts))})

    @property
    def indicators(self) -> list[Indicator]:
        return [i for b in self.blocks.values() for i in b.indicators]

    @property
    def metric(self) -> bool:
        scales = {i.scale for i in self.indicators}
        if None in scales and len(scales) > 1:
            raise TypeError("either all indicators have a scale or none")
        return scales == {None} or not scales

    def check(self, columns: Iterable[str]) -> PathModel:
        wanted = {v for v in self.lvs if v not in self.higher} | {x for _, lvs in self.higher.values() for x in lvs}
        if wanted != set(self.blocks):
            raise ValueError(f"constructs of the path and with blocks differ: {sorted(wanted ^ set(self.blocks))}")
        absent = {i.name for i in self.indicators} - set(columns)
        if absent:
            raise ValueError(f"indicators that are not in the data: {sorted(absent)}")
        self.metric  # noqa: B018  raises on mixed scales
        return self

    def endogenous(self) -> list[str]:
        return [v for v in self.lvs if self.path.loc[v].any()]

    def first_stage_path(self) -> pd.DataFrame:
        """The path with each higher-order construct replaced by its parts: its predecessors lead to
        every part, and every part to its successors."""
        edges = []
        for t in self.lvs:
            for s in self.lvs:
                if self.path.loc[t, s]:
                    for a in self.higher[s][1] if s in self.higher else (s,):
                        for b in self.higher[t][1] if t in self.higher else (t,):
                            edges.append((a, b))
        return Paths(edges).matrix()
