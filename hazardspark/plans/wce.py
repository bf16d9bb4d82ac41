"""Weighted cumulative exposure models."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.functions import splines, tails
from hazardspark.operators import exposure
from hazardspark.plans import replicates
from hazardspark.plans.cox import CoxModel, cox_fit
from hazardspark.sources.scratch import written


@dataclass(frozen=True)
class WceModel:
    cox: CoxModel
    covariates: tuple[str, ...]
    atoms: np.ndarray
    nknots: int
    cutoff: int
    constrained: str | None

    @property
    def spline_coef(self) -> np.ndarray:
        return self.cox.coef[len(self.covariates) :]

    @property
    def spline_vcov(self) -> np.ndarray:
        n = len(self.covariates)
        return self.cox.vcov[n:, n:]

    def curve(self) -> np.ndarray:
        """Weight of a unit dose by lag."""
        return self.atoms @ self.spline_coef

    def curve_table(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        """(lag, weight, lo, hi) with Gaussian bands."""
        q = tails.normal_quantile((1 + level) / 2)
        sd = np.sqrt(np.einsum("lk,kj,lj->l", self.atoms, self.spline_vcov, self.atoms))
        rows = [(i, float(w), float(w - q * s), float(w + q * s)) for i, (w, s) in enumerate(zip(self.curve(), sd))]
        return spark.createDataFrame(rows, "lag int, weight double, lo double, hi double")

    def std(self) -> tuple[np.ndarray, np.ndarray]:
        """Standard errors of the covariates and of the spline coefficients."""
        se, n = self.cox.se, len(self.covariates)
        return se[:n], se[n:]

    def information(self, criterion: str = "bic") -> float:
        p = len(self.cox.coef)
        return -2 * self.cox.loglik + (2 * p if criterion == "aic" else p * math.log(self.cox.events))

    def hazard_ratio(self, exposed: Sequence[float], reference: Sequence[float], level: float = 0.95) -> dict[str, float]:
        """Ratio of two dose histories (most recent dose first), with its Gaussian interval on the log scale (lo, hi) and on the ratio's own (plain_lo, plain_hi)."""
        if len(exposed) != self.cutoff or len(reference) != self.cutoff:
            raise ValueError(f"dose vectors must have length {self.cutoff}")
        a = (np.asarray(exposed, dtype=float) - np.asarray(reference, dtype=float)) @ self.atoms
        log, sd = float(a @ self.spline_coef), math.sqrt(float(a @ self.spline_vcov @ a))
        q = tails.normal_quantile((1 + level) / 2)
        hr = math.exp(log)
        return {"hr": hr, "lo": math.exp(log - q * sd), "hi": math.exp(log + q * sd), "plain_lo": hr - q * sd, "plain_hi": hr + q * sd}

    def total_risk(self) -> dict[str, float]:
        """Sum of the curve over lags, and its standard deviation."""
        a = self.atoms.sum(0)
        return {"risk": float(a @ self.spline_coef), "sd": math.sqrt(float(a @ self.spline_vcov @ a))}

    def risk_band(self, level: float = 0.95) -> np.ndarray:
        """How far each spline coefficient moves when the total risk moves to the edge of its interval."""
        v = self.spline_vcov @ self.atoms.sum(0)
        return tails.normal_quantile((1 + level) / 2) * v / self.total_risk()["sd"]

    def summary(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        """One row per covariate and spline coefficient, as of a Cox model, with the part of the model that it belongs to."""
        of = [(t, "covariate" if t in self.covariates else "exposure") for t in self.cox.covariates]
        return self.cox.summary(spark, level).join(spark.createDataFrame(of, "term string, part string"), "term")


def wce_fit(df: DataFrame, covariates: Sequence[str], cutoff: int, nknots: int = 1, order: int = 3, constrained: str | None = None, id: str = "id", stop: str = "stop", event: str = "event", dose: str = "dose", **options) -> WceModel:
    """Cox fit on covariates and spline features of the dose history; options are cox_fit's (ties, alpha, init, maxiter and so on)."""
    atoms = splines.atoms(cutoff, nknots, order, constrained)
    return _fitted(*wce_rows(df, covariates, atoms, id, stop, event, dose, _columns(options)), covariates, atoms, nknots, cutoff, constrained, stop, event, **options)


def _fitted(rows: DataFrame, names: list[str], covariates: Sequence[str], atoms: np.ndarray, nknots: int, cutoff: int, constrained: str | None, stop: str, event: str, **options) -> WceModel:
    return WceModel(cox_fit(rows, [*covariates, *names], stop, event, **options), tuple(covariates), atoms, nknots, cutoff, constrained)


def _columns(options: dict) -> list[str]:
    """Columns that cox_fit's options name."""
    return [options[k] for k in ("start", "weight", "offset") if options.get(k)]


def wce_rows(df: DataFrame, covariates: Sequence[str], atoms: np.ndarray, id: str = "id", stop: str = "stop", event: str = "event", dose: str = "dose", more: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The outcome, the covariates, more columns and the spline features of each row, and the features' names; written, since fits and replicates read them again and again."""
    kept = dict.fromkeys([id, stop, event, *covariates, *more])
    rows = written(df.select(*kept).join(exposure.features(df, atoms, id, stop, dose), [id, stop]))
    return rows, [f"D{k + 1}" for k in range(atoms.shape[1])]


@dataclass(frozen=True)
class WceBootstrap:
    """A model and the fits (b, term, coef, se, loglik) of its replicates, replicate 0 the sample."""

    model: WceModel
    fits: DataFrame

    def curves(self) -> DataFrame:
        """(b, lag, weight)."""
        # a row for each lag and spline, both few
        atoms = splines.atoms_table(self.fits.sparkSession, self.model.atoms).withColumn("term", F.concat(F.lit("D"), "k"))
        return self.fits.join(F.broadcast(atoms), "term").groupBy("b", "lag").agg(F.sum(F.col("coef") * F.col("value")).alias("weight"))

    def curve(self, level: float = 0.95) -> DataFrame:
        """(lag, lo, hi): quantiles of the weight over replicates."""
        return replicates.quantiles(self.curves(), ["lag"], "weight", level)

    def hazard_ratio(self, exposed: Sequence[float], reference: Sequence[float], level: float = 0.95) -> DataFrame:
        """(contrast, lo, hi): quantiles over replicates of the ratio of two dose histories, most recent dose first."""
        areas = (np.asarray(exposed, dtype=float) - np.asarray(reference, dtype=float)) @ self.model.atoms
        log = replicates.total_risk(self.fits, {f"D{k + 1}": float(a) for k, a in enumerate(areas)}, ["b"])
        return replicates.quantiles(log.select(F.lit("exposed against reference").alias("contrast"), F.exp("risk").alias("hr")), ["contrast"], "hr", level)

    def coefficients(self, level: float = 0.95) -> DataFrame:
        """(term, lo, hi): quantiles over replicates."""
        return replicates.quantiles(self.fits, ["term"], "coef", level)


def wce_bootstrap(df: DataFrame, covariates: Sequence[str], cutoff: int, count: int, batchsize: int = 0, nknots: int = 1, order: int = 3, constrained: str | None = None, unit: str = "row", seed: int = 1, id: str = "id", stop: str = "stop", event: str = "event", dose: str = "dose", **options) -> WceBootstrap:
    """wce_fit and its replicates in one call; features are computed once."""
    atoms = splines.atoms(cutoff, nknots, order, constrained)
    rows, names = wce_rows(df, covariates, atoms, id, stop, event, dose, _columns(options))
    model = _fitted(rows, names, covariates, atoms, nknots, cutoff, constrained, stop, event, **options)
    kept = {k: v for k, v in options.items() if k not in ("singular_ok", "driver_rows")}
    return WceBootstrap(model, replicates.bootstrap_fits(rows, [*covariates, *names], count, batchsize, unit, seed=seed, id=id, stop=stop, event=event, **kept))


def select_knots(df: DataFrame, covariates: Sequence[str], cutoff: int, candidates: Sequence[int] = (1, 2, 3), criterion: str = "bic", **options) -> tuple[WceModel, dict[int, float]]:
    """The model of least information criterion among numbers of inner knots, and all their criteria."""
    models = {k: wce_fit(df, covariates, cutoff, k, **options) for k in candidates}
    values = {k: m.information(criterion) for k, m in models.items()}
    return models[min(values, key=values.get)], values
