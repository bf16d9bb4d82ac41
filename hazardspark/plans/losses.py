"""Convex losses that are sums over rows, minimised by the same Newton iterations with rows in Spark."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.operators import panel
from hazardspark.plans.newton import Optimum, inverse, newton

#: Of rows (a column each) at given coefficients: the loss, its gradient and its Hessian, all sums over the rows.
Part = Callable[[dict[str, np.ndarray], np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def summed(df: DataFrame, part: Callable[[pd.DataFrame], Sequence[np.ndarray]], shapes: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    """Sums over df of arrays that part makes of a batch of rows: each task adds up its batches, and tasks' cells are added in a shuffle."""
    sizes = [int(np.prod(s)) for s in shapes]

    def run(batches):
        total = np.zeros(sum(sizes))
        for batch in batches:
            if len(batch):
                total += np.concatenate([np.ravel(x) for x in part(batch)])
        yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    rows = df.mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(sum(sizes))
    for r in rows:
        flat[r["place"]] = r["value"]
    return [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)]


def minimise(df: DataFrame, columns: Sequence[str], part: Part, init: Sequence[float], maxiter: int = 20, alpha: float = 0.0, singular_ok: bool = False) -> Optimum:
    """The minimum of the sum of part over df's rows, plus alpha times the squared coefficients. Rows with nulls in the columns are dropped; an evaluation is one job."""
    init = np.asarray(init, dtype=float)
    d, columns = len(init), list(columns)
    rows = panel.drop_missing(df.select(*columns), columns).persist()

    def loss(beta: np.ndarray):
        def of(batch: pd.DataFrame):
            return part({c: batch[c].to_numpy(dtype=float) for c in columns}, beta)

        f, g, h = summed(rows, of, [(1,), (d,), (d, d)])
        return float(f[0]) + alpha * float(beta @ beta), g + 2 * alpha * beta, h + 2 * alpha * np.eye(d)

    try:
        return newton(loss, init, maxiter, singular_ok=singular_ok)
    finally:
        rows.unpersist()


def _linear(rows: dict[str, np.ndarray], covariates: Sequence[str], beta: np.ndarray, weight: str | None):
    x = np.column_stack([np.ones(len(next(iter(rows.values())))), *[rows[c] for c in covariates]])
    return x, x @ beta, rows[weight] if weight else np.ones(len(x))


def logistic(y: str, covariates: Sequence[str], weight: str | None = None) -> Part:
    """Of 0/1 outcomes, with an intercept as the first coefficient."""

    def part(rows, beta):
        x, lp, w = _linear(rows, covariates, beta, weight)
        p = np.where(lp >= 0, 1 / (1 + np.exp(-np.abs(lp))), np.exp(-np.abs(lp)) / (1 + np.exp(-np.abs(lp))))
        return float((w * (np.logaddexp(0, lp) - rows[y] * lp)).sum()), x.T @ (w * (p - rows[y])), x.T @ ((w * p * (1 - p))[:, None] * x)

    return part


def poisson(y: str, covariates: Sequence[str], weight: str | None = None) -> Part:
    """Of counts (without the term that no coefficient changes), with an intercept as the first coefficient."""

    def part(rows, beta):
        x, lp, w = _linear(rows, covariates, beta, weight)
        mu = np.exp(np.minimum(lp, 700.0))
        return float((w * (mu - rows[y] * lp)).sum()), x.T @ (w * (mu - rows[y])), x.T @ ((w * mu)[:, None] * x)

    return part


@dataclass(frozen=True)
class LossFit:
    terms: tuple[str, ...]
    coef: np.ndarray
    vcov: np.ndarray
    loglik_init: float
    loglik: float
    score: float

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov))


def fit(df: DataFrame, y: str, covariates: Sequence[str], loss: Callable[..., Part] = logistic, weight: str | None = None, **options) -> LossFit:
    """A regression of y with an intercept, by logistic or poisson; weight: numbers of equal rows. options are minimise's."""
    found = minimise(df, [y, *covariates, *([weight] if weight else [])], loss(y, covariates, weight), np.zeros(len(covariates) + 1), **options)
    return LossFit(("(intercept)", *covariates), found.beta, inverse(found.hessian), -found.loss_init, -found.loss, found.score)
