"""Many fits at once: bootstrap replicates and exposure channels.

Data that fit a task travel there whole and a task makes many fits. Beyond that all fits share their aggregations: each evaluation is one Spark job with a row a fit as its
result. Fits of the same rows (replicates, permutations) are columns of weights beside them, and no rows of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.operators import ordered, panel, resample, riskset
from hazardspark.plans.newton import Kernel, Optimum, inverse, newton, newton_many
from hazardspark.sources.scratch import written

#: Rows times columns that a task may hold for a fit.
TASK_VALUES = 1_000_000
#: Permutations whose risk sets are bits of one number.
BITS = 62
#: Values of Hessians that come to the driver at a time, from fits that share their aggregations.
DRIVER_VALUES = 4_000_000


#: What a fit is beside its coefficients: by name, its value.
STATISTICS = ("loglik_init", "score", "wald")


def _fit_rows(key: tuple, names: Sequence[str], fit: Optimum, init: np.ndarray) -> list[tuple]:
    """key, term, coef, se, loglik and the statistics, a row a term; the Wald test is of the distance from init."""
    away = fit.beta - init
    rest = (-fit.loss, -fit.loss_init, fit.score, float(away @ fit.hessian @ away))
    return [(*key, t, float(c), float(s), *rest) for t, c, s in zip(names, fit.beta, _se(fit.hessian))]


_FIT_ROW = "term string, coef double, se double, loglik double, " + ", ".join(f"{c} double" for c in STATISTICS)


def _se(hessian: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, np.diag(inverse(hessian))))


def grouped_fits(rows: DataFrame, by: Sequence[str], covariates: Sequence[str], stop: str = "stop", event: str = "event", weight: str | None = None, ties: str = "efron", alpha: float = 0.0, maxiter: int = 20, start: str | None = None, offset: str | None = None, init: np.ndarray | None = None, driver_values: int = DRIVER_VALUES) -> DataFrame:
    """by, term, coef, se, loglik and STATISTICS: a fit for each group, evaluated in one aggregation after another by all groups of a batch. Groups without events have no row.

    start: risk sets are of intervals. Batches are as large as their coefficients and Hessians fit the driver.
    """
    spark, names, d = rows.sparkSession, list(covariates), len(covariates)
    init = np.zeros(d) if init is None else np.asarray(init, dtype=float)
    small = riskset.compact(rows.withColumns({c: F.col(c).cast("double") for c in [*names, *([offset] if offset else [])]}), names, stop, event, start, weight, by, offset)
    if not start:
        return vector_fits(small, by, names, 1, stop, event, None, ties, alpha, maxiter, offset, init, driver_values).drop("k")
    small = small.persist()
    held = [small]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    fits, at_once = [], max(1, driver_values // (d + 1) ** 2)
    try:
        # the likelihood does not change when covariates are centred, and rounding is the better for it
        means = small.agg(*[F.avg(c) for c in names]).first()
        centred = small.withColumns({c: F.col(c) - float(m or 0.0) for c, m in zip(names, means)})
        dead = small.where(F.col(event) == 1)
        centred = riskset.cover(centred, names, stop, event, start, by, offset).persist()
        held.append(centred)
        keys = sorted((tuple(r) for r in dead.select(*by).distinct().collect()), key=str)  # a row a fit

        def loss(candidates: dict) -> dict:
            at = spark.createDataFrame([(*k, *map(float, b)) for k, b in candidates.items()], f"{kinds}, " + ", ".join(f"__b{i} double" for i in range(d)))
            # at most at_once rows
            beside = lambda df: df.join(F.broadcast(at), list(by))
            joined = riskset.Cover(beside(centred.alive), beside(centred.dead), centred.times, centred.levels)
            sums = riskset.scaled_sums(joined, names, [F.col(f"__b{i}") for i in range(d)], stop, event, by=by, offset=offset)
            out = {}
            for r in riskset.tied_likelihood(sums, d, ties, by).collect():
                k = tuple(r[c] for c in by)
                out[k] = _penalised(r, candidates[k], alpha)
            return out

        for low in range(0, len(keys), at_once):
            found = newton_many(loss, {k: init for k in keys[low : low + at_once]}, maxiter, singular_ok=True)
            for k, fit in found.items():
                fits += _fit_rows(k, names, fit, init)
    finally:
        for df in held:
            df.unpersist()
    return spark.createDataFrame(fits, f"{kinds}, {_FIT_ROW}")


def _penalised(r, beta: np.ndarray, alpha: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of a row of likelihood, with the penalty."""
    d = len(beta)
    h = np.array([[r[f"h_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) + 2 * alpha * np.eye(d)
    return r["loss"] + alpha * float(beta @ beta), np.array([r[f"g_{i}"] for i in range(d)]) + 2 * alpha * beta, h


def vector_fits(rows: DataFrame, by: Sequence[str], covariates: Sequence[str], count: int, stop: str = "stop", event: str = "event", weight: str | None = None, ties: str = "efron", alpha: float = 0.0, maxiter: int = 20, offset: str | None = None, init: np.ndarray | None = None, driver_values: int = DRIVER_VALUES) -> DataFrame:
    """by, k, term, coef, se, loglik and STATISTICS: for each group count fits of its rows, aligned, with n times their k-th weight (riskset.vector_sums). Fits without events have no row."""
    spark, names, d = rows.sparkSession, list(covariates), len(covariates)
    init = np.zeros(d) if init is None else np.asarray(init, dtype=float)
    # batches of one group and few times
    rows = written(rows.sortWithinPartitions(*by, stop))
    # the likelihood does not change when covariates are centred, and rounding is the better for it
    means = [float(m or 0.0) for m in rows.agg(*[F.avg(c) for c in names]).first()]
    kinds = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by], "k int"])

    def loss(candidates: dict) -> dict:
        at: dict[tuple, list] = {}
        for *key, k in candidates:
            at.setdefault(tuple(key), []).append(k)
        betas = {key: (np.array(ks), np.stack([candidates[(*key, k)] for k in ks])) for key, ks in at.items()}
        sums = riskset.vector_sums(rows, names, betas, stop, event, by, weight, means, offset)
        found = riskset.tied_likelihood(sums, d, ties, [*by, "k"]).collect()  # a row a fit
        return {k: _penalised(r, candidates[k], alpha) for r in found for k in [(*[r[c] for c in by], r["k"])]}

    groups = sorted((tuple(r) for r in rows.select(*by).distinct().collect()), key=str) if by else [()]
    keys, fits, at_once = [(*g, k) for g in groups for k in range(count)], [], max(1, driver_values // (d + 1) ** 2)
    for low in range(0, len(keys), at_once):
        first = loss({k: init for k in keys[low : low + at_once]})
        begun = []

        def once(candidates: dict) -> dict:
            begun.append(1)
            return first if len(begun) == 1 else loss(candidates)  # noqa: B023

        found = newton_many(once, {k: init for k in first}, maxiter, singular_ok=True)
        for k, fit in found.items():
            fits += _fit_rows(k, names, fit, init)
    return spark.createDataFrame(fits, f"{kinds}, {_FIT_ROW}")


def bootstrap_fits(df: DataFrame, covariates: Sequence[str], replicates: int, batchsize: int = 0, unit: str = "row", ties: str = "efron", alpha: float = 0.0, maxiter: int = 20, seed: int = 1, id: str | None = "id", stop: str = "stop", event: str = "event", all_results: bool = True, task_values: int = TASK_VALUES, start: str | None = None, risk_set: str = "aligned", weight: str | None = None, init: Sequence[float] | None = None, doscale: bool = False, offset: str | None = None, statistics: bool = False) -> DataFrame:
    """(b, term, coef, se, loglik, with statistics also STATISTICS): replicate 0 is the sample. Without all_results only replicate 0 has more than coef.

    unit: what is drawn, row (with aligned risk sets after the death-time filter) or subject. Up to task_values values, rows travel to the tasks once and a
    task fits batchsize replicates (0: as many as make 4 tasks a core); beyond it the same draws become weights beside the rows, block by block, and all replicates are fitted by
    shared aggregations.
    Without an id rows are numbered in order of all their columns. The other options are cox_fit's; a replicate's weights multiply the rows' own.
    """
    if batchsize and replicates % batchsize:
        raise ValueError("batchsize must divide replicates")
    if risk_set not in ("aligned", "interval") or (risk_set == "interval" and not start):
        raise ValueError("risk_set is aligned, or interval with start")
    if unit not in ("row", "subject") or (unit == "subject" and not id):
        raise ValueError("unit is row, or subject with an id")
    spark, terms = df.sparkSession, list(covariates)
    used = {"__stop": stop, "__event": event, **{f"__v{i}": c for i, c in enumerate(terms)}}
    used |= {k: c for k, c in (("__id", id), ("__start", start if risk_set == "interval" else None), ("__own", weight), ("__offset", offset)) if c}
    # names of our own, which the draws' b, i and w can't clash with
    rows = panel.drop_missing(df.select(*[F.col(c).alias(k) for k, c in used.items()]), [k for k in used if k != "__id"])
    names = [f"__v{i}" for i in range(len(terms))]
    begin, own, added, whose = (k if k in used else None for k in ("__start", "__own", "__offset", "__id"))
    scale = np.ones(len(names))
    if doscale:
        means = rows.agg(*[F.avg(c) for c in names]).first()
        got = rows.agg(*[F.sum(F.abs(F.col(c) - F.lit(float(m)))) for c, m in zip(names, means)]).first()
        scale = np.array([x or 1.0 for x in got])
        rows = rows.withColumns({c: F.col(c) / float(s) for c, s in zip(names, scale)})
    init = np.zeros(len(names)) if init is None else np.asarray(init, dtype=float) * scale
    order = [whose, "__stop"] if whose else ["__stop", "__event", *[c for c in rows.columns if c not in ("__stop", "__event")]]
    # read for death times, counts, numbers and draws
    rows, limit = written(rows), task_values // (len(names) + 3)
    if begin is None:
        rows = panel.at_death_times(rows, "__stop", "__event")
    if rows.limit(limit + 1).count() > limit:
        keep = [c for c in rows.columns if c != "__id"]
        if unit == "row":
            drawn = resample.weighted_bootstrap(rows, replicates, seed, order, keep)
        else:
            drawn = rows.join(resample.weighted_bootstrap(rows.select(whose).distinct(), replicates, seed, [whose], [whose]), whose).drop(whose)
        drawn = drawn.withColumn("n", (F.col(own) if own else F.lit(1.0)).cast("double"))
        if begin:
            each = drawn.select(*keep, "n", "__slice", F.posexplode("w").alias("k", "w")).where("w > 0").withColumns({"b": F.col("__slice") * resample.SLICE + F.col("k"), "w": F.col("w") * F.col("n")})
            found = grouped_fits(each.drop("n"), ["b"], names, "__stop", "__event", "w", ties, alpha, maxiter, begin, added, init)
        else:
            found = vector_fits(drawn, ["__slice"], names, min(replicates, resample.SLICE), "__stop", "__event", "w", ties, alpha, maxiter, added, init)
            found = found.withColumn("b", F.col("__slice") * resample.SLICE + F.col("k"))
    else:
        found = _task_fits(rows.toPandas(), spark, names, replicates, batchsize, unit, ties, alpha, maxiter, seed, order, begin, own, added, init)
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in zip(names, values) for x in pair]), F.col("term"))
    size, sample = of(map(float, scale)), (F.lit(True) if all_results else F.col("b") == 0)
    return found.select("b", of(terms).alias("term"), (F.col("coef") / size).alias("coef"), F.when(sample, F.col("se") / size).alias("se"), *[F.when(sample, F.col(c)).alias(c) for c in ("loglik", *(STATISTICS if statistics else ()))])


def _task_fits(rows: pd.DataFrame, spark, names: list[str], replicates: int, batchsize: int, unit: str, ties: str, alpha: float, maxiter: int, seed: int, order: list[str], start: str | None, weight: str | None, offset: str | None, init: np.ndarray) -> DataFrame:
    rows = rows.sort_values(order, kind="stable")
    subject = np.unique(rows[order[0]].to_numpy(), return_inverse=True)[1]
    extra = [rows[c].to_numpy() if c else None for c in (start, weight, offset)]
    # of at most TASK_VALUES values
    data = spark.sparkContext.broadcast((rows["__stop"].to_numpy(), rows["__event"].to_numpy(), rows[names].to_numpy(dtype=float), subject, *extra))

    def run(batches):
        at, dead, x, of, begin, own, added = data.value
        n = int(of.max()) + 1 if unit == "subject" else len(at)
        for batch in batches:
            out = []
            for b in batch["id"]:
                w = resample.draws_of(n, int(b), seed)
                w = w[of] if unit == "subject" else w
                w = w if own is None else w * own
                some = w > 0
                kernel = Kernel(at[some], dead[some], x[some], w[some], None if begin is None else begin[some], ties, alpha, None if added is None else added[some])
                fit = newton(kernel, init, maxiter, singular_ok=True)
                out += _fit_rows((int(b),), names, fit, init)
            yield pd.DataFrame(out, columns=["b", "term", "coef", "se", "loglik", *STATISTICS])

    tasks = replicates // batchsize if batchsize else min(replicates, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, replicates, numPartitions=max(1, tasks)).mapInPandas(run, f"b long, {_FIT_ROW}")


def quantiles(df: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """by, lo, hi: interpolated (type 7) quantiles over replicates."""
    q = F.percentile(value, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return df.groupBy(*by).agg(q.alias("q")).select(*by, F.element_at("q", 1).alias("lo"), F.element_at("q", 2).alias("hi"))


def channel_fits(df: DataFrame, channel: str, covariates: Sequence[str], ties: str = "efron", alpha: float = 0.0, maxiter: int = 20, stop: str = "stop", event: str = "event", task_values: int = TASK_VALUES) -> DataFrame:
    """(channel, term, coef, se, loglik): the same outcome on each channel's own covariates.

    df has a block of rows a channel; each is compacted before the shuffle. If all compacted blocks have at most task_values values each is fitted in
    one task; else all channels are fitted by shared aggregations.
    """
    names = list(covariates)
    rows = written(riskset.compact(df, names, stop, event, by=[channel]))
    most = rows.groupBy(channel).count().agg(F.max("count")).first()[0] or 0
    if most * (len(names) + 3) > task_values:
        return vector_fits(rows, [channel], names, 1, stop, event, None, ties, alpha, maxiter).drop("k", *STATISTICS)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = newton(Kernel(pdf[stop], pdf[event], pdf[names], pdf["n"], None, ties, alpha), np.zeros(len(names)), maxiter, singular_ok=True)
        return pd.DataFrame({channel: pdf[channel].iloc[0], "term": names, "coef": found.beta, "se": _se(found.hessian), "loglik": -found.loss})

    kind = df.schema[channel].dataType.simpleString()
    return rows.groupBy(channel).applyInPandas(fit, f"`{channel}` {kind}, term string, coef double, se double, loglik double")


def channel_bootstrap(df: DataFrame, channel: str, covariates: Sequence[str], replicates: int, seed: int = 1, id: str = "id", ties: str = "efron", maxiter: int = 20, stop: str = "stop", event: str = "event") -> DataFrame:
    """(channel, b, term, coef, se, loglik): each channel's fit in each replicate of the subjects; a replicate's draws are the same for all channels."""
    weights = resample.weighted_bootstrap(df.select(id).distinct(), replicates, seed, [id], [id])
    rows = df.join(weights, id).select(channel, "__slice", stop, event, *covariates, F.lit(1.0).alias("n"), "w")
    found = vector_fits(rows, [channel, "__slice"], covariates, min(replicates, resample.SLICE), stop, event, "w", ties, 0.0, maxiter)
    return found.withColumn("b", F.col("__slice") * resample.SLICE + F.col("k")).select(channel, "b", "term", "coef", "se", "loglik")


def permuted_fits(df: DataFrame, channel: str, covariates: Sequence[str], count: int, seed: int = 1, id: str = "id", ties: str = "efron", maxiter: int = 20, stop: str = "stop", event: str = "event") -> DataFrame:
    """(channel, p, term, coef, se, loglik): each channel's fit where in permutation p subjects have the covariates of others at their own times (zero where these have none); 0 is the sample.

    df: a row a channel, subject and time, with one outcome for all channels. Covariates are not copied: beside a row lie the permutations in which it is at risk, or fails, as bits.
    """
    names = list(covariates)
    outcome = df.groupBy(id, stop).agg(F.max(event).alias(event))
    # a subject's own times make one row
    history = outcome.groupBy(id).agg(F.collect_list(F.struct(stop, event)).alias("__own"))
    table = resample.permutations(df, count, seed, id).withColumns({"__slice": F.floor(F.col("p") / BITS), "__bit": F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % BITS).cast("int"))})
    # by other, and so without a further shuffle by its times
    given = table.join(history, id).select("other", "__slice", "__bit", "__own").repartition("other").select("other", "__slice", "__bit", F.inline("__own"))
    mask = lambda dead: F.coalesce(F.bit_or(F.when((F.col(event) == 1) == F.lit(dead), F.col("__bit"))), F.lit(0).cast("long"))
    masks = written(given.groupBy("other", stop, "__slice").agg(mask(False).alias("__alive"), mask(True).alias("__dead")))
    both = F.inline(F.filter(F.array(F.struct(F.lit(0).alias(event), F.col("__alive").alias("w")), F.struct(F.lit(1).alias(event), F.col("__dead").alias("w"))), lambda x: x["w"] != 0))
    found = df.select(channel, F.col(id).alias("other"), stop, *names).join(masks, ["other", stop]).select(channel, "__slice", stop, *names, F.lit(1.0).alias("n"), both)
    # times that the other does not have: numbers of them for each permutation, with zero covariates
    alone = masks.join(df.select(F.col(id).alias("other"), stop).distinct(), ["other", stop], "left_anti").select("__slice", stop, both)
    bit = F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("__k")
    alone = alone.select("__slice", stop, event, "w", bit).where(F.call_function("shiftright", F.col("w"), F.col("__k")) % 2 == 1).groupBy("__slice", stop, event, "__k").agg(F.count("*").cast("double").alias("n"))
    empty = alone.crossJoin(F.broadcast(df.select(channel).distinct())).select(channel, "__slice", stop, *[F.lit(0.0).alias(c) for c in names], "n", event, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__k")).alias("w"))
    fits = vector_fits(found.unionByName(empty), [channel, "__slice"], names, min(count + 1, BITS), stop, event, "w", ties, 0.0, maxiter)
    return fits.select(channel, (F.col("__slice") * BITS + F.col("k")).cast("int").alias("p"), "term", "coef", "se", "loglik")


def total_risk(fits: DataFrame, areas: dict[str, float], by: Sequence[str]) -> DataFrame:
    """by, risk: sum over terms of coef * area."""
    area = F.create_map(*[F.lit(x) for kv in areas.items() for x in kv])
    return fits.where(F.col("term").isin(list(areas))).groupBy(*by).agg(F.sum(F.col("coef") * F.element_at(area, F.col("term"))).alias("risk"))


def permutation_test(risks: DataFrame, channel: str, p: str = "p") -> DataFrame:
    """channel, risk, rank of the real risk (permutation 0) among all permutations, p_value, and max-rank adjusted p_value.

    Ranks are of absolute risks within a channel; the adjusted value compares with each permutation's greatest rank.
    """
    # of many fits, and read again and again
    risks = written(risks)
    ranked = risks.withColumn("rank", F.rank().over(Window.partitionBy(channel).orderBy(F.abs("risk"))))
    top = written(ranked.groupBy(p).agg(F.max("rank").cast("long").alias("max_rank")))
    real = ranked.where(F.col(p) == 0).select(channel, "risk", F.col("rank").cast("long").alias("rank"), (F.col("rank") - 1).cast("long").alias("__below"))
    single = ranked.join(real.select(channel, F.col("rank").alias("__r")), channel).groupBy(channel).agg(F.avg((F.col("rank") >= F.col("__r")).cast("double")).alias("p_value"))
    # permutations whose greatest rank is under the real one, looked up by equality
    counts = top.groupBy("max_rank").agg(F.count("*").alias("__n"))
    joint = ordered.up_to(real, counts, "max_rank", ["__n"], ["__below"])
    adjusted = 1 - F.coalesce(F.col("__n___below"), F.lit(0)) / F.lit(top.count())
    return joint.join(single, channel).select(channel, "risk", "rank", "p_value", adjusted.alias("adjusted_p"))
