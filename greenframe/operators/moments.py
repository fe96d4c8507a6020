"""First and second moments of all pairs of numeric columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


@dataclass
class PairMoments:
    """Per pair (i, j) over the rows where both are present, as d x d arrays."""

    n: np.ndarray
    mean_x: np.ndarray
    mean_y: np.ndarray
    var_x: np.ndarray
    var_y: np.ndarray
    cov: np.ndarray

    def correlation(self) -> np.ndarray:
        """Pearson's coefficient; NaN where a column does not vary."""
        spread = np.sqrt(self.var_x * self.var_y)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(spread > 0, self.cov / spread, np.nan)


def column_means(df: DataFrame) -> list[float]:
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return [means[f"m{i}"] or 0.0 for i in range(len(df.columns))]


def pair_sums(df: DataFrame, centers: list[float], change: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Sums over all pairs of columns (doubles, null where missing), relative to ``centers``.

    ``change`` makes other numbers (NaN where missing) of an array of rows before they are added up.

    Every task adds up its rows by matrix products and sends d x d sums, so one
    scan serves any number of pairs; only the summed matrices come to the driver.
    Sums of disjoint sets of rows may be added.
    """
    d, offsets = len(df.columns), np.array(centers)

    def partial(batches):
        sums = np.zeros((len(SUMS), d, d))
        for batch in batches:
            raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns])
            raw = change(raw) if change else raw
            here = (~np.isnan(raw)).astype(float)
            x = np.where(here > 0, raw - offsets, 0.0)
            squares = x * x
            sums += [here.T @ here, x.T @ here, here.T @ x, squares.T @ here, here.T @ squares, x.T @ x]
        flat = sums.reshape(len(SUMS), d * d)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int32)), *map(pa.array, flat)], ["at", *SUMS])

    schema = "at int, " + ", ".join(f"{name} double" for name in SUMS)
    rows = df.mapInArrow(partial, schema).groupBy("at").agg(*[F.sum(name).alias(name) for name in SUMS]).collect()
    total = np.zeros((len(SUMS), d * d))
    for row in rows:
        total[:, row["at"]] = [row[name] for name in SUMS]
    return total.reshape(len(SUMS), d, d)


def moments_of(sums: np.ndarray, centers: list[float]) -> PairMoments:
    n, sx, sy, sxx, syy, sxy = sums
    offsets = np.array(centers)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_x, mean_y = sx / n, sy / n
        var_x, var_y, cov = sxx / n - mean_x**2, syy / n - mean_y**2, sxy / n - mean_x * mean_y
        # what rounding leaves of the variance of equal values is no variance
        var_x = np.where(var_x > 1e-12 * sxx / n, var_x, 0.0)
        var_y = np.where(var_y > 1e-12 * syy / n, var_y, 0.0)
    return PairMoments(n, mean_x + offsets[:, None], mean_y + offsets[None, :], var_x, var_y, cov)


def pair_moments(df: DataFrame, centers: list[float] | None = None, change: Callable[[np.ndarray], np.ndarray] | None = None) -> PairMoments:
    """Moments of the columns of ``df``; sums are taken relative to the column means to keep the digits."""
    centers = column_means(df) if centers is None else centers
    return moments_of(pair_sums(df, centers, change), centers)
