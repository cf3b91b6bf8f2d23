"""Grid density clustering: cells, dense neighbours, minimum labels to convergence.

Features are quantised to cells; a cell is dense when it holds clearly more records than evenly
scattered records would put there. Dense cells that touch (also at edges and corners) are joined, and
minimum labels are propagated with hooking and pointer jumping until nothing changes. Only cells are ever joined,
never pairs of records: a cell of any number of records is one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentspark.sources import materialise

MAX_ROUNDS = 60


def cell_width(rows: int, spread: float) -> float:
    """Edge of a cell: it shrinks with the 8th root of the number of records, so that the records in
    a cell still grow (in three dimensions as rows ** 5/8) while the grid gets finer."""
    return 0.6 * spread * max(rows, 1) ** -0.125


def dense_count(rows: int, noise_share: float, cell_share: float) -> int:
    """Records that make a cell dense: above the mean of scattered records by four deviations."""
    mean = rows * noise_share * cell_share
    return max(2, math.ceil(mean + 4 * math.sqrt(mean) + 1))


def beyond_chance(size: Column, cells: Column, mean: float, places: float, dims: int, chance: float) -> Column:
    """Whether ``size`` records in ``cells`` touching cells are more than scattered records, ``mean`` a
    cell, would put anywhere: the bound on the Poisson tail, times the number of groups of so many
    cells in a grid of ``places``, is below ``chance``. It does not depend on the share of all rows."""
    expected = cells * F.lit(mean)
    tail = size * F.log(size / expected) - size + expected
    groups = math.log(max(places, 1.0)) + (cells - 1) * math.log(math.e * (3**dims - 1))
    return (size > expected) & (tail >= groups - math.log(chance))


def _neighbours(cells: DataFrame, dims: Sequence[str], label: str) -> DataFrame:
    """(cell columns, label of a touching cell), by an exploded equi-join."""
    offsets = [o for o in product((-1, 0, 1), repeat=len(dims)) if any(o)]
    steps = F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(d) for d, x in zip(dims, o)]) for o in offsets])
    moved = cells.select(*dims, label, F.explode(steps).alias("_o"))
    return moved.select(*[(F.col(d) + F.col(f"_o.{d}")).alias(d) for d in dims], F.col(label).alias("_from"))


def label_components(cells: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dims, label) where touching cells share a label.

    A round hands each cell, and the cell that its label names, the smallest label of its neighbours'
    labels, and replaces labels by their own labels; chains of any length settle in about as many
    rounds as their length has bits. Every round is written out, so that a lost executor costs one
    round and plans stay short."""
    cells = materialise(cells.select(*dims, F.xxhash64(*dims).alias("id")), "cells")
    edges = cells.select(*dims, "id").join(_neighbours(cells, dims, "id"), list(dims)).select("id", F.col("_from").alias("other"))
    edges = materialise(edges, "edges")
    labels = materialise(cells.select("id", F.col("id").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        further = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        known = labels.join(further, "label")
        near = edges.join(known.select(F.col("id").alias("other"), "further"), "other").groupBy("id").agg(F.min("further").alias("near"))
        known = known.join(near, "id", "left")
        own = known.select("id", F.least("label", "further", F.coalesce("near", "label")).alias("new"), F.col("label").alias("old"))
        hook = known.select(F.col("label").alias("id"), F.col("near").alias("new"), F.lit(None).cast("bigint").alias("old"))
        new = own.unionByName(hook).groupBy("id").agg(F.min("new").alias("label"), F.max("old").alias("old"))
        new = materialise(new, "labels")
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return cells.join(labels, "id").select(*dims, "label")
    raise RuntimeError(f"labels did not settle in {MAX_ROUNDS} rounds")


class GridClusters:
    """Clusters of a table over numeric feature columns.

    noise_share: the share of records taken as scattered evenly over the data's bounding box, which
    sets the density a cell must exceed. chance: how probable it may be that scattered records form any
    of the groups of dense cells that count as clusters.
    """

    def __init__(self, df: DataFrame, features: dict[str, Column], row_id: str, noise_share: float = 0.05, chance: float = 0.05):
        self.dims = [f"_g{i}" for i in range(len(features))]
        self.names = list(features)
        self.points = df.select(F.col(row_id), *[c.alias(n) for n, c in features.items()]).dropna(subset=self.names)
        bounds = self.points.agg(
            F.count(F.lit(1)),
            *[f(n) for n in self.names for f in (F.min, F.max, F.stddev_pop)],
        ).first()
        self.rows = bounds[0]
        lows, highs, devs = bounds[1::3], bounds[2::3], bounds[3::3]
        spread = max([d for d in devs if d] or [1.0])
        self.width = cell_width(self.rows, spread)
        share = 1.0
        for lo, hi in zip(lows, highs):
            share *= min(1.0, self.width / ((hi - lo) or self.width)) if self.rows else 1.0
        self.dense = dense_count(self.rows, noise_share, share)
        counts = self.cells(self.points).groupBy(*self.dims).agg(F.count(F.lit(1)).alias("n"))
        self.counts = materialise(counts.filter(F.col("n") >= self.dense), "counts")
        labelled = label_components(self.counts, self.dims).join(self.counts, self.dims)
        sizes = labelled.groupBy("label").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("_cells"))
        mean = self.rows * noise_share * share
        kept = sizes.filter(beyond_chance(F.col("size"), F.col("_cells"), mean, 1 / share, len(self.dims), chance)).drop("_cells")
        self.labelled = materialise(labelled.join(kept, "label"), "clusters")

    def cells(self, points: DataFrame) -> DataFrame:
        return points.withColumns({d: F.floor(F.col(n) / self.width).cast("bigint") for d, n in zip(self.dims, self.names)})

    def assign(self, points: DataFrame) -> DataFrame:
        """Points of a cluster with ``label``, ``size`` and their cell's count ``n``; others drop out."""
        return self.cells(points).join(self.labelled, self.dims)


def clusters(df: DataFrame, features: dict[str, Column], row_id: str, typical: int = 5, **options) -> DataFrame:
    """(row_id, label, size, typical): each clustered record, its cluster's size and whether it is one
    of its ``typical`` most typical members: of the densest cell, nearest to that cell's centre.

    Records with a NULL feature, and scattered ones, come out in no cluster. Repeated rows count as
    often as they come. Labels are the minimum hash of a cluster's cells: stable for the same cells.
    An empty table has no clusters; a table of equal records is one cluster (if it has two or more).
    """
    grid = GridClusters(df, features, row_id, **options)
    members = grid.assign(grid.points)
    core = grid.labelled.groupBy("label").agg(F.max_by(F.struct(*grid.dims), F.struct("n", *grid.dims)).alias("core"))
    away = sum((F.pow(F.col(n) - (F.col(f"core.{d}") + 0.5) * grid.width, 2) for n, d in zip(grid.names, grid.dims)), F.lit(0.0))
    inside = members.join(core, "label")
    for d in grid.dims:
        inside = inside.filter(F.col(d) == F.col(f"core.{d}"))
    # the smallest (distance, id) of each cluster's densest cell; a bounded heap per task, then merged
    from latentspark.llm.top import smallest

    best = smallest(inside.select("label", away.alias("away"), row_id), "label", ["away", row_id], typical)
    best = best.select("label", row_id, F.lit(True).alias("typical"))
    marked = members.join(best, ["label", row_id], "left")
    return marked.select(row_id, "label", "size", F.coalesce("typical", F.lit(False)).alias("typical"))
