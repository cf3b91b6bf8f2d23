"""Moments per event-time window, in batch or as a stream with a watermark.

The aggregates are Spark's own (count, avg, covar_samp), so state is one row per open window and late
rows beyond the watermark are dropped. A window's row is all a fit needs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from latentspark.kernel.weights import Extended, NoConvergence
from latentspark.model import estimate, numbers
from latentspark.moments import Moments
from latentspark.spec import PathModel, Scheme

MIN_ROWS = 10
PATHS = "window_start timestamp, window_end timestamp, n bigint, source string, target string, estimate double, status string"


def windowed_moments(df: DataFrame, ts: str, columns: Sequence[str], window: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(window, n, m0.., c0_0..) of complete rows; ``window``, ``slide`` and ``watermark`` as Spark
    writes durations. Rows with a NULL time or value count nowhere."""
    x = numbers(df, columns, [ts]).dropna(subset=[ts, *columns])
    if watermark is not None:
        x = x.withWatermark(ts, watermark)
    aggs = [F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)]
    for i, a in enumerate(columns):
        aggs += [F.covar_samp(f"`{a}`", f"`{b}`").alias(f"c{i}_{j}") for j, b in enumerate(columns[: i + 1])]
    return x.groupBy(F.window(ts, window, slide)).agg(F.count(F.lit(1)).alias("n"), *aggs)


def row_moments(row: Row, columns: Sequence[str]) -> Moments:
    p, n = len(columns), float(row["n"])
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            v = row[f"c{i}_{j}"]
            cov[i, j] = cov[j, i] = np.nan if v is None else v
    return Moments(tuple(columns), n, np.array([row[f"m{i}"] for i in range(p)]), cov * (n - 1))


def fit_windows(windows: DataFrame, model: PathModel, scheme: Scheme = Scheme.CENTROID, tolerance: float = 1e-6, least: int = MIN_ROWS) -> DataFrame:
    """Paths of every window, on the executors: one kernel run per window row. A window of fewer than
    ``least`` rows, or one that cannot be fitted, as without variance in a column, has NULL estimates
    and the reason as its status."""
    import pandas as pd

    columns = [i.name for i in model.indicators]
    unfitted = [(s, v, None) for v in model.endogenous() for s in model.lvs if model.path.loc[v, s]]

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                status = "ok" if row["n"] >= least else "too few rows"
                try:
                    if row["n"] < least:
                        raise NoConvergence(status)
                    found = estimate(model, Extended(row_moments(row, columns), {}), scheme, tolerance).tables.inner_model()
                except (NoConvergence, np.linalg.LinAlgError):
                    found, status = unfitted, status if status != "ok" else "not fitted"
                out += [(row["window_start"], row["window_end"], int(row["n"]), r[0], r[1], r[2], status) for r in found]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PATHS.split(", ")])

    flat = windows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in windows.columns if c != "window"])
    return flat.mapInPandas(run, PATHS)


def write_fits(stream: DataFrame, ts: str, model: PathModel, window: str, watermark: str, path: str, checkpoint: str, slide: str | None = None, scheme: Scheme = Scheme.CENTROID):
    """Starts a query that appends the paths of each closed window to Parquet files at ``path``."""
    columns = [i.name for i in model.indicators]
    fits = fit_windows(windowed_moments(stream, ts, columns, window, slide, watermark), model, scheme)
    return fits.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
