"""Cox proportional-hazards fits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.functions import tails
from hazardspark.operators import panel, riskset
from hazardspark.plans import losses, replicates
from hazardspark.plans.formula import Design, Formula, design, parse
from hazardspark.plans.newton import Kernel, Optimum, aliased, inverse, newton
from hazardspark.sources.scratch import written

#: Compacted rows up to which a fit runs on the driver; beyond it every evaluation is a Spark aggregation.
DRIVER_ROWS = 100_000
#: Replicates whose coefficients are literals of one plan.
LITERALS = 200


@dataclass(frozen=True)
class CoxModel:
    covariates: tuple[str, ...]
    coef: np.ndarray
    vcov: np.ndarray
    loglik_init: float
    loglik: float  # with the penalty, if any
    score: float
    gradient: np.ndarray
    means: np.ndarray
    n: int
    events: int
    ties: str
    alpha: float = 0.0
    init: np.ndarray = field(default_factory=lambda: np.zeros(0))
    evaluations: int = 0
    penalty: float = 0.0
    #: Terms without information of their own: their coefficients count as 0, with zero variance, and are not a number in results.
    aliased: tuple[bool, ...] = ()
    design: Design | None = None
    offset: str | None = None

    @property
    def df(self) -> int:
        """Terms that are not aliased."""
        return len(self.coef) - sum(self.aliased)

    def coefficients(self) -> dict[str, float]:
        """By term, not a number for an aliased one."""
        gone = self.aliased or (False,) * len(self.coef)
        return {t: math.nan if g else float(b) for t, b, g in zip(self.covariates, self.coef, gone)}

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.vcov))

    @property
    def loglik_data(self) -> float:
        return self.loglik + self.penalty

    def tests(self) -> dict[str, float]:
        """Likelihood-ratio, Wald and score tests, their p values, pseudo R squared and its maximum."""
        df = self.df
        lr = 2 * (self.loglik - self.loglik_init)
        away = self.coef - self.init
        wald = float(away @ inverse(self.vcov) @ away)
        return {
            "df": df, "lr": lr, "lr_p": tails.chi2_tail(lr, df), "wald": wald, "wald_p": tails.chi2_tail(wald, df),
            "score": self.score, "score_p": tails.chi2_tail(self.score, df),
            "rsq": 1 - math.exp(-lr / self.n), "max_rsq": 1 - math.exp(2 * self.loglik_init / self.n),
        }

    def summary(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        """One row per term: coef, exp_coef, se, z, p, and the interval of coef and of exp(coef)."""
        q = tails.normal_quantile((1 + level) / 2)
        rows = []
        for (name, b), s in zip(self.coefficients().items(), self.se):
            s = math.nan if math.isnan(b) else s
            z = b / s if s > 0 else float("nan")
            rows.append((name, float(b), math.exp(b), math.exp(-b), float(s), float(z), tails.normal_two_sided(z), float(b - q * s), float(b + q * s), math.exp(b - q * s), math.exp(b + q * s)))
        return spark.createDataFrame(rows, "term string, coef double, exp_coef double, exp_minus_coef double, se double, z double, p double, coef_lo double, coef_hi double, lo double, hi double")

    def confint(self, spark: SparkSession, terms: Sequence[str | int] | None = None, level: float = 0.95) -> DataFrame:
        """(term, lo, hi) of the coefficients: all, or those given by name or by number from 1."""
        q, rows = tails.normal_quantile((1 + level) / 2), []
        for t in self.covariates if terms is None else terms:
            if (t not in self.covariates) if isinstance(t, str) else not 1 <= t <= len(self.covariates):
                raise ValueError(f"no such term: {t}")
            i = self.covariates.index(t) if isinstance(t, str) else t - 1
            b = self.coefficients()[self.covariates[i]]
            rows.append((self.covariates[i], float(b - q * self.se[i]), float(b + q * self.se[i])))
        return spark.createDataFrame(rows, "term string, lo double, hi double")

    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.df

    def bic(self) -> float:
        return -2 * self.loglik + self.df * math.log(self.events)

    def linear_predictor(self, df: DataFrame, out: str = "lp") -> DataFrame:
        """df with lp = coef . (x - mean), and the offset if the model has one; columns whose values lie in -1, 0, 1 are not centred."""
        names = self.design.names if self.design else list(self.covariates)
        rows = self.design.matrix(df) if self.design else df
        checks = rows.agg(*[F.min(F.col(c).isin(-1, 0, 1)).alias(c) for c in names]).first()
        centre = [0.0 if checks[c] else float(m) for c, m in zip(names, self.means)]
        lp = riskset.predictor(names, self.coef, centre) + (F.col(self.offset) if self.offset else F.lit(0.0))
        return rows.withColumn(out, lp).drop(*[n for n in names if n not in df.columns])

    def risk(self, df: DataFrame, out: str = "risk") -> DataFrame:
        """df with exp(lp), shifted where it would overflow."""
        rows = self.linear_predictor(df, "__lp")
        top = rows.agg(F.max("__lp")).first()[0] or 0.0
        return rows.withColumn(out, F.exp(F.col("__lp") - F.lit(max(0.0, top - 709.0)))).drop("__lp")


def scaled(df: DataFrame, column: str, out: str, unit: float = 1.0) -> DataFrame:
    """df with the column's deviation from its mean over the sum of absolute deviations, times unit; of a constant column zero."""
    mean = df.agg(F.avg(column)).first()[0] or 0.0
    total = df.agg(F.sum(F.abs(F.col(column) - F.lit(mean)))).first()[0] or 1.0
    return df.withColumn(out, (F.col(column) - F.lit(mean)) / F.lit(total) * F.lit(float(unit)))


def evaluate_wide(rows: DataFrame | riskset.Cover, covariates: Sequence[str], beta: np.ndarray, stop: str, event: str, ties: str, alpha: float, offset: str | None = None, by: Sequence[str] = ()) -> tuple[float, np.ndarray, np.ndarray]:
    """evaluate for many covariates: sums of first moments by time, then second moments of all rows at once, each weighed by what its times say."""
    d = len(covariates)
    key = [*by, "t" if isinstance(rows, DataFrame) else "no"]
    columns = lambda kind: [f"{kind}_{i}" for i in range(d)]
    times = riskset.scaled_sums(rows, covariates, beta, stop, event, by=by, offset=offset, order=1).persist()

    def scales(pdf: pd.DataFrame) -> np.ndarray:
        """Per time: sums over its ties of 1/s, c/s, 1/s^2, c/s^2, c^2/s^2 and log s, for s = a + c d."""
        out = np.zeros((len(pdf), 6))
        for i, (a, dead, w) in enumerate(zip(pdf["a"], pdf["d"], pdf["deaths"])):
            c, n = (np.arange(1, round(w) + 1) / w, 1.0) if ties == "efron" else (np.ones(1), w)
            s = a + c * dead
            out[i] = n * np.array([(1 / s).sum(), (c / s).sum(), (1 / s**2).sum(), (c / s**2).sum(), (c**2 / s**2).sum(), np.log(s).sum()])
        return out

    def marks(batches):
        for pdf in batches:
            q = scales(pdf)
            yield pd.DataFrame({**{k: pdf[k] for k in key}, "top": pdf["top"], "alpha": q[:, 0], "beta": q[:, 1]})

    def of_times(pdf: pd.DataFrame):
        q, a, dead = scales(pdf), pdf[columns("a")].to_numpy(), pdf[columns("d")].to_numpy()
        ties_of = pdf["deaths"].to_numpy()
        loss = (q[:, 5] + ties_of * pdf["top"] - pdf["lp"]).sum()
        g = q[:, 0] @ a + q[:, 1] @ dead - pdf[columns("x")].to_numpy().sum(0)
        cross = a.T @ (q[:, 3, None] * dead)
        return np.array([loss]), g, a.T @ (q[:, 2, None] * a) + cross + cross.T + dead.T @ (q[:, 4, None] * dead)

    def of_rows(pdf: pd.DataFrame):
        x = pdf[covariates].to_numpy()
        return (x.T @ (pdf["w"].to_numpy()[:, None] * x),)

    try:
        loss, g, outer = losses.summed(times, of_times, [(1,), (d,), (d, d)])
        kinds = ", ".join(f"`{k}` {times.schema[k].dataType.simpleString()}" for k in key)
        marked = times.select(*key, "top", "a", "d", "deaths").mapInPandas(marks, f"{kinds}, top double, alpha double, beta double")
        second = losses.summed(riskset.weighted_rows(rows, marked, covariates, beta, stop, event, by, offset), of_rows, [(d, d)])[0]
    finally:
        times.unpersist()
    return float(loss[0]) + alpha * float(beta @ beta), g + 2 * alpha * beta, second - outer + 2 * alpha * np.eye(d)


def evaluate(rows: DataFrame | riskset.Cover, covariates: Sequence[str], beta: np.ndarray, stop: str, event: str, ties: str, alpha: float, offset: str | None = None, by: Sequence[str] = ()) -> tuple[float, np.ndarray, np.ndarray]:
    """One aggregation job over compacted rows, or over the cover of interval risk sets; by: strata, whose risk sets are their own."""
    d = len(covariates)
    if isinstance(rows, DataFrame):
        one = (np.zeros(1, dtype=int), np.asarray(beta, dtype=float)[None, :])
        keys = [tuple(r) for r in rows.select(*by).distinct().collect()] if by else [()]  # a row a stratum
        sums = riskset.vector_sums(rows, covariates, {k: one for k in keys}, stop, event, by, None, None, offset)
    else:
        sums = riskset.scaled_sums(rows, covariates, beta, stop, event, by=by, offset=offset)
    got = riskset.tied_likelihood(sums, d, ties).first()
    g = np.array([got[f"g_{i}"] for i in range(d)]) + 2 * alpha * beta
    h = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            h[i, j] = h[j, i] = got[f"h_{i}_{j}"]
    return got["loss"] + alpha * float(beta @ beta), g, h + 2 * alpha * np.eye(d)


def cox_fit(df: DataFrame, covariates: Sequence[str], stop: str = "stop", event: str = "event", start: str | None = None, ties: str = "efron", risk_set: str = "aligned", alpha: float = 0.0, maxiter: int = 20, init: Sequence[float] | None = None, doscale: bool = False, weight: str | None = None, singular_ok: bool = False, driver_rows: int = DRIVER_ROWS, offset: str | None = None, strata: str | None = None) -> CoxModel:
    """Fit by Newton iterations on compacted rows, on the driver if these are few and by Spark aggregations if not; both sum risks at each risk set's own scale.

    risk_set: aligned (rows with equal stop) or interval (start < t <= stop, needs start). doscale divides covariates by the sum of absolute
    deviations from their mean for the iterations (constant ones stay), and the penalty alpha is on that scale; results are on the original one. Rows with nulls in
    used columns are dropped. weight: numbers of equal rows, or any with Breslow's ties. offset: a column added to the linear predictor. strata: a column whose values have risk sets and a
    baseline of their own. Without events the coefficients are not a number,
    with zero variance. Information that is singular (a term is a combination of those before it) raises; with singular_ok such terms are aliased.
    """
    covariates = list(covariates)
    if risk_set not in ("aligned", "interval") or (risk_set == "interval" and not start):
        raise ValueError("risk_set is aligned, or interval with start")
    if ties not in ("efron", "breslow"):
        raise ValueError("ties is efron or breslow")
    used = start if risk_set == "interval" else None
    init = np.zeros(len(covariates)) if init is None else np.asarray(init, dtype=float)
    if len(init) != len(covariates):
        raise ValueError("init needs a value for each covariate")
    columns = [*([start] if start else []), stop, event, *covariates, *([weight] if weight else []), *([offset] if offset else []), *([strata] if strata else [])]
    rows = panel.drop_missing(df.select(*{c: None for c in columns}), columns)
    rows = rows.withColumns({c: F.col(c).cast("double") for c in [*covariates, *([offset] if offset else [])]})
    events = panel.validate(rows, stop, event, [*covariates, *([offset] if offset else [])], start, weight, ties == "efron")
    facts = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(covariates)]).first()
    means = np.array([facts[f"m_{i}"] for i in range(len(covariates))])
    if not events:
        none = np.full(len(covariates), np.nan)
        return CoxModel(tuple(covariates), none, np.zeros((len(none), len(none))), 0.0, 0.0, 0.0, np.zeros(len(none)), means, int(facts["n"]), 0, ties, alpha, init, offset=offset)
    scale = np.ones(len(covariates))
    if doscale:
        scale = spread(rows, covariates, means)
    by = [strata] if strata else []
    small = riskset.compact(rows, covariates, stop, event, used, weight, by, offset).persist()
    held = [small]
    try:
        if small.limit(driver_rows + 1).count() <= driver_rows:
            table = small.toPandas()
            parts = [t for _, t in table.groupby(strata)] if strata else [table]
            loss = of_strata([Kernel(t[stop], t[event], t[covariates] / scale, t["n"], t[used] if used else None, ties, 0.0, t[offset] if offset else None) for t in parts], alpha)
        else:
            # the likelihood does not change when covariates are centred, and rounding is the better for it
            centred = small.withColumns({c: (F.col(c) - float(m)) / float(s) for c, m, s in zip(covariates, means, scale)})
            if used:
                centred = riskset.cover(centred, covariates, stop, event, used, by, offset).persist()
                held.append(centred)
            if len(covariates) > riskset.WIDE:
                loss = lambda b: evaluate_wide(centred, covariates, b, stop, event, ties, alpha, offset, by)
            else:
                loss = lambda b: evaluate(centred, covariates, b, stop, event, ties, alpha, offset, by)
        found = newton(loss, init * scale, maxiter, singular_ok=singular_ok)
    finally:
        for df in held:
            df.unpersist()
    return replace(model_of(found, covariates, means, int(facts["n"]), events, ties, alpha, init, scale), offset=offset)


def of_strata(kernels: Sequence[Kernel], alpha: float):
    """The sum of the kernels' losses, with the penalty once."""

    def loss(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        f, g, h = (sum(x) for x in zip(*[k(beta) for k in kernels]))
        return f + alpha * float(beta @ beta), g + 2 * alpha * beta, h + 2 * alpha * np.eye(len(beta))

    return loss


def spread(rows: DataFrame, covariates: Sequence[str], means: np.ndarray) -> np.ndarray:
    """Sum of absolute deviations of each covariate from its mean; 1 for a constant one."""
    got = rows.agg(*[F.sum(F.abs(F.col(c) - F.lit(float(m)))).alias(f"s_{i}") for i, (c, m) in enumerate(zip(covariates, means))]).first()
    return np.array([x or 1.0 for x in got])


def model_of(found: Optimum, covariates: Sequence[str], means: np.ndarray, n: int, events: int, ties: str, alpha: float, init: np.ndarray, scale: np.ndarray | None = None) -> CoxModel:
    scale = np.ones(len(covariates)) if scale is None else scale
    return CoxModel(
        tuple(covariates), found.beta / scale, inverse(found.hessian) / np.outer(scale, scale), -found.loss_init, -found.loss, found.score,
        -found.gradient * scale, means, n, events, ties, alpha, init, found.evaluations, alpha * float(found.beta @ found.beta), tuple(map(bool, aliased(found.hessian))),
    )


def _modelled(formula: str, df: DataFrame, options: dict, more: Sequence[str] = ()) -> tuple[Formula, Design, DataFrame, dict]:
    """The formula, its design, rows with the design's columns, and cox_fit's options; right-censored times are intervals that begin before all times."""
    f = parse(formula, df.columns)
    d = design(f, df)
    if not d.names:
        raise ValueError("no covariates")
    kept = list(dict.fromkeys([f.stop, f.event, *d.names, *([f.offset] if f.offset else []), *([options["weight"]] if options.get("weight") else []), *more]))
    rows = d.matrix(df)
    if f.start is None:
        first = df.agg(F.min(f.stop)).first()[0]
        start = F.lit((first if first is not None else 0) - 1).cast(df.schema[f.stop].dataType).alias("__start")
        # also here: rows with nulls in variables of the formula are dropped, whatever columns they make
        rows = panel.drop_missing(rows, [f.stop, f.event, *f.used()]).select(start, *kept)
        return f, d, rows, {**options, "start": "__start", "risk_set": "interval", "offset": f.offset}
    return f, d, rows.select(f.start, *[c for c in kept if c != f.start]), {**options, "start": f.start, "offset": f.offset}


def cox(formula: str, df: DataFrame, **options) -> CoxModel:
    """cox_fit from a formula; right-censored Surv(time, status) are intervals that begin before all times, with their true risk sets."""
    f, d, rows, options = _modelled(formula, df, options)
    return replace(cox_fit(rows, d.names, f.stop, f.event, **options), covariates=d.labels, design=d)


@dataclass(frozen=True)
class CoxBootstrap:
    """A model and the fits (b, term, coef, se, loglik) of its replicates, replicate 0 the sample; with all results also their statistics, and the rows that they are of."""

    model: CoxModel
    fits: DataFrame
    rows: DataFrame | None = None
    times: tuple[str, str, str] = ("start", "stop", "event")

    def confint(self, level: float = 0.95) -> DataFrame:
        """(term, lo, hi): quantiles of the coefficients over replicates."""
        return replicates.quantiles(self.fits, ["term"], "coef", level)

    def predictors(self) -> DataFrame:
        """(b, start, stop, event, n, lp): each replicate's linear predictor, without centring, of the distinct rows, n of each.

        Rows are compacted first. Coefficients, a row a replicate, reach the tasks as literals, LITERALS replicates at a time.
        """
        if self.rows is None:
            raise ValueError("replicates have predictors with all_results only")
        names = self.model.design.names
        found: dict[int, dict[str, float]] = {}
        for r in self.fits.select("b", "term", "coef").collect():  # a row a replicate and term
            found.setdefault(r["b"], {})[r["term"]] = r["coef"]
        extra = [self.model.offset] if self.model.offset else []
        small = self.rows.groupBy(*self.times, *names, *extra).agg(F.count("*").alias("n"))
        parts, order = [], sorted(found)
        for low in range(0, len(order), LITERALS):
            betas = [F.struct(F.lit(b).cast("long").alias("b"), F.array(*[F.lit(found[b][t]) for t in self.model.covariates]).alias("beta")) for b in order[low : low + LITERALS]]
            each = small.select(*self.times, *names, *extra, "n", F.inline(F.array(*betas)))
            lp = riskset.predictor(names, [F.get("beta", i) for i in range(len(names))])
            parts.append(each.select("b", *self.times, "n", (lp + F.col(extra[0]) if extra else lp).alias("lp")))
        return reduce(DataFrame.unionAll, parts)

    def results(self) -> DataFrame:
        """A row a replicate: b, loglik, STATISTICS, df, and concordant, discordant, tied_x and concordance of its own predictor on the rows."""
        start, stop, event = self.times
        fits = self.fits.groupBy("b").agg(*[F.first(c).alias(c) for c in ("loglik", *replicates.STATISTICS)], F.count(F.when(F.col("se") > 0, 1)).cast("int").alias("df"))
        pairs = riskset.concordance(self.predictors(), "lp", start, stop, event, ["b"], "n")
        return fits.join(pairs.select("b", "concordant", "discordant", "tied_x", "concordance"), "b")


def cox_bootstrap(formula: str, df: DataFrame, count: int, batchsize: int = 0, unit: str = "row", seed: int = 1, id: str = "id", all_results: bool = False, task_values: int = replicates.TASK_VALUES, **options) -> CoxBootstrap:
    """cox and its replicates, in one call, of any formula and with all of cox_fit's options. Without all_results only the sample's fit has se and loglik.

    Replicates are drawn from the rows in order of id and stop; tables without the column id (unit row only) in order of all used columns.
    """
    f, d, rows, options = _modelled(formula, df, options, [id] if id in df.columns else [])
    model = replace(cox_fit(rows, d.names, f.stop, f.event, **options), covariates=d.labels, design=d)
    options = {k: v for k, v in options.items() if k not in ("singular_ok", "driver_rows")}
    fits = replicates.bootstrap_fits(rows, d.names, count, batchsize, unit, seed=seed, id=id if id in df.columns else None, stop=f.stop, event=f.event, all_results=all_results, task_values=task_values, statistics=all_results, **options)
    label = F.create_map(*[F.lit(x) for pair in zip(d.names, d.labels) for x in pair])
    fits = fits.withColumn("term", F.element_at(label, F.col("term")))
    if not all_results:
        return CoxBootstrap(model, fits)
    # read again for predictors and results
    return CoxBootstrap(model, written(fits), panel.drop_missing(rows, [f.stop, f.event, *d.names]), (options["start"], f.stop, f.event))
