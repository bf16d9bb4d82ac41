"""B-spline bases of exposure lags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def knots(cutoff: int, nknots: int = 1, order: int = 3) -> list[float]:
    """order + 1 outer knots below and above, and nknots inner ones at quantiles of 1..cutoff, rounded half to even."""
    if cutoff < 1 or nknots < 0 or order < 1:
        raise ValueError("need cutoff >= 1, nknots >= 0 and order >= 1")
    days = np.arange(1, cutoff + 1)
    inner = [float(np.round(np.quantile(days, i / (nknots + 1)))) for i in range(1, nknots + 1)]
    return [*map(float, range(-order, 1)), *inner, *map(float, range(cutoff, cutoff + order + 1))]


def basis(points: np.ndarray, at: list[float], order: int = 3) -> np.ndarray:
    """Values of all B-splines of degree order over the knots, half-open on the right."""
    t, u = np.asarray(at, dtype=float), np.asarray(points, dtype=float)[:, None]
    b = ((t[:-1] <= u) & (u < t[1:])).astype(float)
    for k in range(1, order + 1):
        n = len(t) - k - 1
        left, right = t[k : k + n] - t[:n], t[k + 1 : k + 1 + n] - t[1 : 1 + n]
        rise = np.divide(u - t[:n], left, out=np.zeros((len(u), n)), where=left > 0)
        fall = np.divide(t[k + 1 : k + 1 + n] - u, right, out=np.zeros((len(u), n)), where=right > 0)
        b = rise * b[:, :n] + fall * b[:, 1 : n + 1]
    return b


def kept_columns(count: int, constrained: str | None, order: int = 3) -> range:
    """Basis columns that stay: all, without the last order - 1 (right), or without the first (left)."""
    side = (constrained or "").strip().lower()[:1]
    if side not in ("", "r", "l"):
        raise ValueError("constrained is left, right or nothing")
    if side and order < 2:
        raise ValueError("a constraint needs order 2 or more")
    return range(order - 1 if side == "l" else 0, count - (order - 1) if side == "r" else count)


def atoms(cutoff: int, nknots: int = 1, order: int = 3, constrained: str | None = None, at: list[float] | None = None) -> np.ndarray:
    """Values (lag, basis) for lags 0 to cutoff - 1: the splines at lag + 1."""
    values = basis(np.arange(1, cutoff + 1), at or knots(cutoff, nknots, order), order)
    return values[:, list(kept_columns(values.shape[1], constrained, order))]


def atoms_table(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """(lag, k, value), k from 1; as many rows as values, which are few."""
    rows = [(lag, k + 1, float(x)) for lag, row in enumerate(values) for k, x in enumerate(row)]
    return spark.createDataFrame(rows, "lag int, k int, value double")
