"""Published and hand-derived values, invariants and degenerate cases of the models."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazardspark.functions import splines, tails
from hazardspark.operators import exposure, ordered, panel, resample, riskset
from hazardspark.plans import cox, losses, replicates, wce
from hazardspark.plans.formula import design, parse
from hazardspark.plans.multistate import Transition, coefficients, stack
from hazardspark.plans.newton import Kernel, Singular, aliased, factor, inverse, newton, solve
from hazardspark.sources import panels

SF = "/root/testdata/sf0.01"
TEST1B = [
    (0, 3, 0, 2.0, 1), (3, 9, 1, 2.0, 1), (0, 3, 0, 1.0, 3), (0, 1, 1, 1.0, 3), (0, 6, 1, 1.0, 5), (0, 6, 1, 0.0, 6), (0, 8, 0, 0.0, 7),
]


@pytest.fixture(scope="module")
def days(spark):
    return panels.person_days(spark, SF).persist()


def test_five_rows(spark):
    df = spark.createDataFrame([(1, 0, -1.0), (1, 0, 4.0), (1, 1, 0.0), (2, 0, -3.0), (2, 0, 3.0)], "time int, death int, x double")
    for ties in ("efron", "breslow"):
        m = cox.cox_fit(df, ["x"], "time", "death", ties=ties)
        assert math.isclose(m.coef[0], -math.log(4) / 5, abs_tol=1e-6) and abs(m.loglik + 0.974327) < 1e-6
        assert abs(m.loglik_init + math.log(3)) < 1e-9 and abs(m.se[0] - 0.633697) < 1e-6 and abs(m.score - 0.214286) < 1e-6


@pytest.mark.parametrize("ties,coef,loglik,se,score", [("breslow", 1.475285, -3.824750, 1.255734, 1.6), ("efron", 1.676857, -3.358975, 1.277616, 2.036145)])
def test_right_censored_ties(spark, ties, coef, loglik, se, score):
    df = spark.createDataFrame(list(zip([9, 3, 1, 1, 6, 6, 8], [1, None, 1, 0, 1, 1, 0], [0.0, 2.0, 1.0, 1.0, 1.0, 0.0, 0.0])), "time int, status int, x double")
    m = cox.cox("Surv(time, status) ~ x", df.na.drop(), ties=ties)
    k = cox.cox_fit(df.na.drop().withColumn("start", F.lit(0)), ["x"], "time", "status", "start", ties=ties, risk_set="interval")
    for found in (m, k):
        got = (found.coef[0], found.loglik, found.se[0], found.score)
        assert np.allclose(got, (coef, loglik, se, score), atol=2e-6)


def test_goldens_of_the_panel(days):
    m = cox.cox_fit(days, ["sex", "age"])
    assert np.allclose(m.coef, (-0.192284, 0.004037), atol=1e-6) and np.allclose(m.se, (0.245879, 0.008431), atol=1e-6)
    assert np.allclose((m.loglik_init, m.loglik, m.score), (-318.126973, -317.731932, 0.789130), atol=1e-5)
    b = cox.cox_fit(days, ["sex", "age"], ties="breslow")
    assert np.allclose(b.coef, (-0.190591, 0.004043), atol=1e-6) and abs(b.score - 0.780215) < 1e-5
    r = cox.cox_fit(days, ["sex", "age"], alpha=0.1)
    assert np.allclose(r.coef, (-0.189987, 0.004031), atol=1e-6) and abs(r.loglik + 317.735587) < 1e-5 and r.loglik_data > r.loglik


@pytest.mark.parametrize("options,coef,loglik,bic,hr", [
    ({"cutoff": 7}, (-0.182160, 0.004263, -6.868261, 1.668651, -1.043674, 0.709751, -1.750607), -314.893811, 659.2205, 0.357497),
    ({"cutoff": 7, "constrained": "right"}, (-0.186459, 0.004330, -5.205142, 0.957602, -0.345500), -315.789872, 652.6032, 0.507420),
    ({"cutoff": 7, "constrained": "Left"}, (-0.183563, 0.004032, -0.123811, 0.214704, -1.133413), -317.105201, 655.2339, 0.610233),
    ({"cutoff": 10, "nknots": 2}, (-0.181004, 0.004136, -3.462769, 0.197048, 0.371417, -0.846699, 0.860809, -0.738727), -314.642310, 662.9222, 0.439142),
])
def test_exposure_models(days, options, coef, loglik, bic, hr):
    m = wce.wce_fit(days, ["sex", "age"], **options)
    n = options["cutoff"]
    assert np.allclose(m.cox.coef, coef, atol=2e-6) and abs(m.cox.loglik - loglik) < 1e-5 and abs(m.information() - bic) < 1e-3
    assert abs(m.hazard_ratio([1] * n, [0] * n)["hr"] - hr) < 1e-5
    with pytest.raises(ValueError):
        m.hazard_ratio([1], [0] * n)


@pytest.mark.parametrize("cutoff,nknots,areas", [
    (90, 1, (10.322473, 22.927760, 22.999766, 22.989130, 10.760870)),
    (90, 3, (4.638333, 11.862553, 17.249113, 22.5, 17.0, 11.479167, 5.270833)),
    (10, 1, (0.669643, 2.593344, 2.987013, 2.916667, 0.833333)),
    (180, 2, (14.0553, 30.444834, 45.249867, 45.25, 30.241935, 14.758065)),
])
def test_spline_areas_and_partition_of_unity(cutoff, nknots, areas):
    a = splines.atoms(cutoff, nknots)
    assert np.allclose(a.sum(0), areas, atol=1e-6) and np.allclose(a.sum(1), 1)


def test_constraints_cut_columns():
    assert list(splines.kept_columns(5, "Right")) == [0, 1, 2] and list(splines.kept_columns(5, "l")) == [2, 3, 4]
    for bad in (("sideways", 3), ("right", 1)):
        with pytest.raises(ValueError):
            splines.kept_columns(5, *bad)


def test_tails():
    assert abs(tails.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(tails.chi2_tail(33.88, 2) - math.exp(-16.94)) < 1e-12
    assert abs(tails.chi2_tail(0.5, 3) - 0.918891) < 1e-6 and abs(tails.normal_two_sided(1.959964) - 0.05) < 1e-6


def test_driver_and_distributed_fits_agree(days):
    for options in ({}, {"ties": "breslow"}, {"start": "start", "risk_set": "interval"}, {"alpha": 0.5}):
        a, b = (cox.cox_fit(days, ["sex", "age"], driver_rows=n, **options) for n in (10**6, 0))
        assert np.allclose(a.coef, b.coef, atol=1e-8) and math.isclose(a.loglik, b.loglik, rel_tol=1e-9)


def test_scaling_and_weights_change_nothing(days):
    m, s = cox.cox_fit(days, ["sex", "age"]), cox.cox_fit(days, ["sex", "age"], doscale=True)
    assert np.allclose(m.coef, s.coef, atol=1e-8) and np.allclose(m.vcov, s.vcov, rtol=1e-6)
    table = days.toPandas()
    twice = Kernel(np.repeat(table["stop"], 2), np.repeat(table["event"], 2), np.repeat(table[["sex", "age"]].to_numpy(), 2, axis=0), ties="breslow")
    once = Kernel(table["stop"], table["event"], table[["sex", "age"]], np.full(len(table), 2.0), ties="breslow")
    assert np.allclose(twice(np.array([0.1, 0.01]))[1], once(np.array([0.1, 0.01]))[1])


def test_one_iteration_returns_init(days):
    assert cox.cox_fit(days, ["sex", "age"], maxiter=1, init=[0.5, 0.1]).coef.tolist() == [0.5, 0.1]


def test_martingale_residuals_sum_to_zero(days):
    for ties in ("efron", "breslow"):
        r = riskset.martingale(days.withColumn("risk", F.exp(0.3 * F.col("sex") - 0.01 * F.col("age"))), ties=ties)
        assert abs(r.agg(F.sum("resid")).first()[0]) < 1e-8


def test_intervals_and_aligned_sets_differ_on_unsplit_data(spark):
    df = spark.createDataFrame(TEST1B, "start int, stop int, status int, x double, id int")
    split = panel.split_at(df, panel.death_times(df, "stop", "status").select("stop"), "start", "stop", "status")
    a = cox.cox_fit(split, ["x"], "stop", "status", "start")
    b = cox.cox_fit(df, ["x"], "stop", "status", "start", risk_set="interval")
    assert np.allclose(a.coef, b.coef, atol=1e-8) and split.count() > df.count()


@pytest.mark.parametrize("rows,error", [
    ([], "no rows are left"), ([(1, 2, 1.0)], "0 or 1"), ([(1, 1, float("inf")), (1, 0, 0.0)], "not finite"),
])
def test_bad_input(spark, rows, error):
    with pytest.raises(ValueError, match=error):
        cox.cox_fit(spark.createDataFrame(rows, "stop int, event int, x double"), ["x"])


def test_no_events_give_no_coefficients(spark):
    m = cox.cox_fit(spark.createDataFrame([(1, 0, 1.0), (2, 0, 3.0)], "stop int, event int, x double"), ["x"])
    assert np.isnan(m.coef).all() and (m.vcov == 0).all() and (m.loglik_init, m.loglik, m.events, m.n) == (0.0, 0.0, 0, 2) and m.means.tolist() == [2.0]


def test_weights(spark):
    rows = [(t, d, x, w) for t, d, x, w in zip((1, 1, 2, 2, 3, 4), (1, 1, 0, 1, 1, 0), (0.0, 1.0, 1.0, 0.0, 1.0, 0.0), (2, 1, 3, 2, 1, 2))]
    df = spark.createDataFrame(rows, "time int, status int, x double, w int")
    many = resample.repeat_rows(df)
    for ties in ("efron", "breslow"):
        a, b = cox.cox("Surv(time, status) ~ x", df, weight="w", ties=ties), cox.cox("Surv(time, status) ~ x", many, ties=ties)
        assert np.allclose((a.coef[0], a.loglik), (b.coef[0], b.loglik), atol=1e-9)
    half = df.withColumn("w", F.col("w") / 4)
    with pytest.raises(ValueError, match="whole|fractions"):
        cox.cox("Surv(time, status) ~ x", half, weight="w")
    fits = [cox.cox("Surv(time, status) ~ x", half, weight="w", ties="breslow", driver_rows=n).coef[0] for n in (0, 1000)]
    assert np.allclose(fits, cox.cox("Surv(time, status) ~ x", df, weight="w", ties="breslow").coef[0], atol=1e-8)
    with pytest.raises(ValueError, match="negative"):
        cox.cox("Surv(time, status) ~ x", df.withColumn("w", -F.col("w")), weight="w", ties="breslow")
    some = df.withColumn("w", F.when(F.col("time") != 3, F.col("w")))  # null weights and starts drop the row
    assert cox.cox("Surv(time, status) ~ x", some, weight="w").n == cox.cox("Surv(time, status) ~ x", some.na.drop(), weight="w").n


TIES = st.lists(st.tuples(st.integers(0, 3), st.integers(1, 4), st.integers(0, 1), st.integers(0, 2)), min_size=2, max_size=12)


def brute_residuals(rows, ties):
    out = []
    for s, t, d, x in rows:
        used = 0.0
        for u in sorted({q for _, q, e, _ in rows if e}):
            if s < u <= t:
                den = sum(1.0 + y for a, b, _, y in rows if a < u <= b)
                dead = [1.0 + y for _, b, e, y in rows if e and b == u]
                n, eden = len(dead), sum(dead)
                mine = d and u == t
                for k in range(n):
                    part = 1 / (den - (k / n) * eden) if ties == "efron" else 1 / den
                    used += part * ((1 - k / n) if mine and ties == "efron" else 1)
        out.append((s, t, d, x, round(d - (1.0 + x) * used, 9)))
    return sorted(out)


@settings(deadline=None, max_examples=2, derandomize=True)
@given(TIES)
def test_repeated_rows_are_rows(spark, drawn):
    rows = [(s, s + n, d, x) for s, n, d, x in drawn]
    rows += rows[: len(rows) // 2 + 1]  # repeat some
    df = spark.createDataFrame(rows, "start int, stop int, event int, x int").withColumn("risk", 1.0 + F.col("x"))
    for ties in ("efron", "breslow"):
        got = riskset.martingale(df, ties=ties, keys=["start", "stop", "event", "x"]).collect()
        want = brute_residuals(rows, ties)
        assert np.allclose(sorted((*r[:4], r[4]) for r in got), want, atol=1e-6)
    cuts = sorted({t for _, t, d, _ in rows if d})
    split = panel.split_at(df.drop("risk"), spark.createDataFrame([(c,) for c in [*cuts, 3]], "c int"))
    want = []
    for s, t, d, x in rows:
        ends = [c for c in sorted({*cuts, 3}) if s < c < t] + [t]
        want += [(a, b, d if b == t else 0, x) for a, b in zip([s, *ends], ends)]
    assert sorted(map(tuple, split.select("start", "stop", "event", "x").collect())) == sorted(want)
    pairs = [(y, z) for s, t, d, y in rows if d for a, b, e, z in rows if a < t <= b and not (e and b == t)]
    c = riskset.concordance(df, "risk").first()
    assert (c.concordant, c.discordant, c.tied_x) == (sum(a > b for a, b in pairs), sum(a < b for a, b in pairs), sum(a == b for a, b in pairs))
    kept = panel.ever_at_risk(df).count()
    assert kept == sum(any(s < u <= t for u in cuts) for s, t, _, _ in rows)


def test_plans_have_no_nested_loops_or_windows_over_everything(spark, days):
    risky = days.withColumn("risk", F.exp(0.1 * F.col("age")))
    for df in (
        riskset.martingale(risky), panel.ever_at_risk(days), panel.split_at(days.select("start", "stop", "event"), panel.death_times(days).select("stop")),
        riskset.members(days), riskset.hazards(risky), riskset.sums(riskset.compact(days, ["sex"], start="start"), ["sex"], [0.1], start="start"), resample.permutations(days, 3),
    ):
        hold_plan(df)
    hold_plan(riskset._pairs_by_score(risky, "risk", "start", "stop", "event")[1])


def hold_plan(df):
    """No nested loops, and windows without a partition only over the ranges' totals, of which there are few."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert set(re.findall(r"windowspecdefinition\((\w+)#\d+L? (?:ASC|DESC)", plan)) <= {"__range"}


def test_prefix_sums_over_outlying_times(spark):
    rows = [(g, t, float(v)) for g in (1, 2) for t, v in zip([-1e9, 0.0, 0.25, 1.0, 7.5, 1e12], [1, 2, 3, 4, 5, 6])]
    df = spark.createDataFrame(rows, "g int, t double, v double")
    up = {(r.g, r.t): r.v for r in ordered.prefix_sums(df, "t", ["v"], ["g"]).collect()}
    down = {(r.g, r.t): r.v for r in ordered.prefix_sums(df, "t", ["v"], ["g"], descending=True).collect()}
    for g, t, _ in rows:
        assert up[g, t] == sum(v for h, u, v in rows if h == g and u <= t) and down[g, t] == sum(v for h, u, v in rows if h == g and u >= t)
    assert ordered.prefix_sums(df.limit(0), "t", ["v"]).count() == 0


def test_times_of_a_chain_become_one(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.0 + 4e-10, 1.0 + 8e-10, 2.0, None)], "t double")
    got = [r.t for r in panel.merge_times(df, "t").collect()]
    assert sorted(x for x in got if x) == [1.0, 1.0, 1.0, 2.0] and None in got


def test_confint_summary_and_bands(spark, days):
    m = cox.cox_fit(days, ["sex", "age"])
    rows = m.confint(spark, ["age", 1], 0.9).collect()
    assert [r.term for r in rows] == ["age", "sex"] and rows[0].lo < m.coef[1] < rows[0].hi
    for bad in (["size"], [3], [0]):
        with pytest.raises(ValueError):
            m.confint(spark, bad)
    w = wce.wce_fit(days, ["sex"], 7, ties="breslow", alpha=0.01)
    s = {r.term: r for r in w.summary(spark).collect()}
    assert s["sex"].part == "covariate" and s["D1"].part == "exposure" and abs(s["D1"].exp_minus_coef - math.exp(-w.cox.coef[1])) < 1e-9
    hr, t, se = w.hazard_ratio([1] * 7, [0] * 7), w.total_risk(), w.std()
    assert math.isclose(hr["hr"] - hr["plain_lo"], hr["plain_hi"] - hr["hr"]) and np.isclose(w.risk_band() @ w.atoms.sum(0), 1.959964 * t["sd"], rtol=1e-5)
    assert len(se[0]) == 1 and len(se[1]) == 5 and w.cox.loglik_data > w.cox.loglik


def test_penalty_is_on_the_scaled_covariates(days):
    a = cox.cox_fit(days, ["sex", "age"], doscale=True, alpha=1e-9)
    scaled = cox.scaled(cox.scaled(days, "sex", "s"), "age", "a")
    b = cox.cox_fit(scaled, ["s", "a"], alpha=1e-9)
    total = [float(days.agg(F.sum(F.abs(F.col(c) - F.lit(m)))).first()[0]) for c, m in zip(("sex", "age"), a.means)]
    assert np.allclose(a.coef * total, b.coef, rtol=1e-6) and math.isclose(a.loglik, b.loglik, rel_tol=1e-9)


def test_risk_scores_do_not_overflow(spark):
    df = spark.createDataFrame([(1, 900.0), (2, 1500.0), (3, 0.0)], "id int, x double")
    m = cox.CoxModel(("x",), np.array([1.0]), np.eye(1), 0.0, 0.0, 0.0, np.zeros(1), np.zeros(1), 1, 1, "efron")
    risk = {r.id: r.risk for r in m.risk(df).collect()}
    assert all(math.isfinite(x) for x in risk.values()) and math.isclose(math.log(risk[2] / risk[1]), 600, rel_tol=1e-9)


def test_bootstrap_paths_agree_and_batches_change_nothing(days):
    for unit in ("row", "subject"):
        a, b, c = (replicates.bootstrap_fits(days, ["sex", "age"], 4, unit=unit, **o).toPandas().sort_values(["b", "term"]) for o in ({}, {"task_values": 0}, {"batchsize": 2}))
        assert np.allclose(a[["coef", "se", "loglik"]], b[["coef", "se", "loglik"]], atol=1e-7) and np.allclose(a.coef, c.coef)
    both = cox.cox_bootstrap("Surv(start, stop, event) ~ sex", days, 3)
    rows = both.fits.toPandas().set_index("b")
    assert np.allclose(rows.loc[0, ["coef", "se", "loglik"]].astype(float), (both.model.coef[0], both.model.se[0], both.model.loglik)) and rows.se.isna().sum() == 2


def test_channels_of_any_size_agree(days):
    rows = days.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("channel"), "id", "stop", "event", F.col("age").cast("double").alias("age"))
    rows = rows.withColumn("age", F.when(F.col("channel") == "b", F.col("age") % 7).otherwise(F.col("age")))
    a, b = (replicates.channel_fits(rows, "channel", ["age"], **o).toPandas().sort_values("channel") for o in ({}, {"task_values": 0}))
    assert np.allclose(a[["coef", "se", "loglik"]], b[["coef", "se", "loglik"]], atol=1e-7) and list(a.channel) == ["a", "b"]


def test_sinks_and_readers(spark, days, tmp_path):
    panels.write_results(days, str(tmp_path / "p"), ["sex"])
    back = panels.read_panel(spark, str(tmp_path / "p"), ["id", "stop", "dose"])
    assert back.columns == ["id", "stop", "dose"] and sorted(back.collect()) == sorted(days.select("id", "stop", "dose").collect())


def test_daily_events_with_a_watermark(spark, tmp_path):
    from hazardspark.streaming.riskset import daily_events

    ev = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    ev.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = daily_events(stream, "ts", "60 days").writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = ev.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()
    got = spark.table("daily").select(F.to_date("day.start").alias("d"), "event_type", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_singular_information(spark):
    df = spark.createDataFrame([(t, t in (1, 3, 5), 1.0 * t) for t in range(1, 13)], "stop int, event boolean, x double").withColumn("event", F.col("event").cast("int"))
    with pytest.raises(Singular):
        cox.cox_fit(df, ["x"])
    assert cox.cox_fit(df, ["x"], singular_ok=True).coef.tolist() == [0.0]


def test_other_bad_arguments(days):
    for options in ({"ties": "exact"}, {"init": [1.0]}, {"maxiter": 0}, {"risk_set": "interval"}):
        with pytest.raises(ValueError):
            cox.cox_fit(days, ["sex", "age"], **options)
    with pytest.raises(ValueError):
        replicates.bootstrap_fits(days, ["sex"], 10, batchsize=3)


def test_newton_on_a_convex_loss():
    def loss(b):
        e = np.exp(b - np.array([1.0, -2.0]))
        return float((e - b).sum()), e - 1, np.diag(e)

    assert np.allclose(newton(loss, np.array([4.0, 3.0])).beta, (1, -2), atol=1e-6)


def test_formulas():
    assert parse("Surv(a, b, c) ~ x + y").covariates == ("x", "y") and parse("Surv(t, s) ~ x").start is None
    assert parse("Surv(a, b, c) ~ . - y", ["a", "b", "c", "x", "y", "z"]).covariates == ("x", "z")
    for bad in ("x ~ y", "Surv(a) ~ x", "Surv(a, b, c) ~ strata(x)", "Surv(a, b, c) ~ x*", "Surv(a, b, c) ~ :y", "Surv(a, b) ~ offset(x) + offset(y)", "Surv(a, b) ~ log(x)", "Surv(a, b) ~ x y"):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        parse("Surv(a, b) ~ q", ["a", "b"])


def test_replicate_zero_is_the_fit_and_weights_agree(spark, days):
    fits = replicates.bootstrap_fits(days, ["sex", "age"], 4).toPandas()
    assert np.allclose(fits[fits.b == 0].coef, cox.cox_fit(days, ["sex", "age"]).coef, atol=1e-8)
    table = resample.draws(spark, 500, 3, 7).toPandas()
    for b in range(3):
        w = np.zeros(500, dtype=int)
        part = table[table.b == b]
        w[part.i] = part.w
        assert (w == resample.draws_of(500, b, 7)).all() and w.sum() == 500
    assert abs((resample.draws_of(20_000, 5) == 0).mean() - math.exp(-1)) < 0.02


def test_permutations_are_permutations(days):
    table = resample.permutations(days, 3).toPandas()
    for p, rows in table.groupby("p"):
        assert sorted(rows.id) == sorted(rows.other) and (p != 0 or (rows.id == rows.other).all())


def test_exposure_against_dense_convolution(spark):
    rows = [(i, t, float(i == 0 and t == 0) + (i == 1) * ((t == 5) + 2.0 * (t == 10))) for i in range(2) for t in range(-5, 30)]
    values = splines.atoms(20)
    got = exposure.features(spark.createDataFrame(rows, "id int, stop int, dose double"), values).toPandas().set_index(["id", "stop"])
    dose = {(i, t): d for i, t, d in rows}
    for (i, t), r in got.iterrows():
        want = sum(dose.get((i, t - lag), 0.0) * values[lag] for lag in range(20))
        assert np.allclose(r.to_numpy(), want)


def test_summary_tests_and_simulators(spark, days):
    m = cox.cox_fit(days, ["sex", "age"])
    s = {r.term: r for r in m.summary(spark).collect()}
    assert abs(s["sex"].z - m.coef[0] / m.se[0]) < 1e-12 and s["sex"].lo < s["sex"].exp_coef < s["sex"].hi
    assert abs(m.tests()["lr"] - 2 * (m.loglik - m.loglik_init)) < 1e-12 and m.bic() > m.aic()
    doses, events = panels.drug_cohort(spark, 2, 20, 30)
    assert doses.count() == 1200 and events.where("event = 1").groupBy("patient").count().where("count > 1").count() == 0
    histories = panels.dose_histories(spark.range(5), 60)
    assert histories.agg(F.max("day")).first()[0] <= 60
    import pandas as pd

    times = pd.DataFrame({"time": [3, 9, 20, 41, 60], "status": [1, 0, 1, 1, 0]})
    drawn = panels.permutational_events(histories.select(F.lit(0).cast("long").alias("scenario"), "id", "day", F.col("dose").alias("x")), times, 0.5).toPandas()
    assert drawn.id.is_unique and sorted(drawn.follow_up) <= sorted(times.time)


def test_streaming_counts_match_batch(spark, days, tmp_path):
    from hazardspark.streaming.riskset import running_counts

    days.select("stop", "event").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stop int, event int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = days.groupBy("stop", "event").count().collect()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, want))


def _odd_table(spark, seed, n=120):
    """Large, negative and nearly collinear covariates, ties and weights."""
    r = np.random.default_rng(seed)
    start = r.integers(0, 4, n)
    stop = start + r.integers(1, 6, n)
    a = 2000 + r.integers(-15, 15, n)
    rows = [(int(s), int(t), int(d), float(y), float(-4e5 - 3 * y + z), float(z), int(w)) for s, t, d, y, z, w in zip(start, stop, r.random(n) < 0.5, a, r.normal(size=n), r.integers(1, 4, n))]
    return spark.createDataFrame(rows, "start int, stop int, event int, a double, b double, c double, w int")


def test_paths_agree_on_large_negative_and_collinear_covariates(spark):
    df = _odd_table(spark, 1).persist()
    for options, boot in (
        ({"ties": "breslow", "weight": "w", "doscale": True, "init": [0.01, 0.0]}, True), ({"start": "start", "risk_set": "interval", "weight": "w", "alpha": 0.3}, False), ({"start": "start", "risk_set": "interval", "offset": "c"}, True),
    ):
        m, s = (cox.cox_fit(df, ["a", "b"], driver_rows=n, **options) for n in (10**6, 0))
        assert np.allclose(m.coef, s.coef, atol=1e-7) and np.allclose(m.se, s.se, rtol=1e-6) and math.isclose(m.loglik, s.loglik, rel_tol=1e-9), options
        g, t = (replicates.bootstrap_fits(df, ["a", "b"], 2, id=None, task_values=n if boot else 10**7, **options).toPandas().sort_values(["b", "term"]) for n in (10**7, 0))
        assert np.allclose(g[["coef", "se", "loglik"]], t[["coef", "se", "loglik"]], rtol=1e-6, atol=1e-7), options
        assert np.allclose(g[g.b == 0].coef, m.coef, atol=1e-7) and np.allclose(g[g.b == 0].se, m.se, rtol=1e-6), options
    away = np.array([5.0, -7.0])  # far from the optimum risks differ by factors beyond any double
    for start in (None, "start"):
        small = riskset.compact(df, ["a", "b"], start=start)
        rows = riskset.cover(small, ["a", "b"], "stop", "event", start) if start else small
        f, g, h = cox.evaluate(rows, ["a", "b"], away, "stop", "event", "efron", 0.0)
        table = small.toPandas()
        k = Kernel(table["stop"], table["event"], table[["a", "b"]], table["n"], table[start] if start else None)(away)
        assert math.isclose(f, k[0], rel_tol=1e-9) and np.allclose(g, k[1], rtol=1e-7) and np.allclose(h, k[2], rtol=1e-5, atol=1e-3)
    df.unpersist()


def test_interval_sums_at_every_time(spark):
    df = _odd_table(spark, 5)
    got = {r.t: r for r in riskset.sums(riskset.compact(df, ["c"], start="start"), ["c"], [0.5], start="start").collect()}
    rows = df.toPandas()
    for t in sorted(rows[rows.event == 1].stop.unique()):
        at, dead = rows[(rows.start < t) & (rows.stop >= t)], rows[(rows.stop == t) & (rows.event == 1)]
        assert math.isclose(got[t].a + got[t].d, np.exp(0.5 * at.c).sum()) and math.isclose(got[t].a_0 + got[t].d_0, (at.c * np.exp(0.5 * at.c)).sum()) and got[t].deaths == len(dead)
    assert len(got) == rows[rows.event == 1].stop.nunique()


def test_ties_in_chunks(spark, monkeypatch):
    df = spark.createDataFrame([(1 + i % 3, int(i % 4 < 3), i % 7 / 3) for i in range(200)], "stop int, event int, x double")
    small = riskset.compact(df, ["x"])
    want = riskset.likelihood(riskset.scaled_sums(small, ["x"], [0.3]), 1).first()
    monkeypatch.setattr(riskset, "TIES", 7)
    rows = riskset.likelihood(riskset.scaled_sums(small, ["x"], [0.3]), 1, most_ties=60)
    assert np.allclose(list(want), list(rows.first()), rtol=1e-12) and "hashpartitioning(t" in rows._jdf.queryExecution().executedPlan().toString()
    risky = df.withColumn("risk", F.exp(F.col("x")))
    a = riskset.hazards(risky, start=None).orderBy("t").toPandas()
    monkeypatch.setattr(riskset, "TIES", 4096)
    assert np.allclose(a, riskset.hazards(risky, start=None).orderBy("t").toPandas(), rtol=1e-12)


def test_rank_revealing_factor():
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 4)) * [1, 1e4, 1e-3, 1]
    x = np.column_stack([x[:, 0], x[:, 1], 2 * x[:, 0] - x[:, 1], x[:, 2], np.zeros(40), x[:, 3]])
    h = x.T @ x
    gone = aliased(h)
    assert gone.tolist() == [False, False, True, False, True, False]
    keep = ~gone
    want = np.zeros((6, 6))
    want[np.ix_(keep, keep)] = np.linalg.inv(h[np.ix_(keep, keep)])
    assert np.allclose(inverse(h), want, rtol=1e-6)
    g = r.normal(size=6)
    assert np.allclose(solve(h, g, singular_ok=True), want @ g, rtol=1e-6)
    with pytest.raises(Singular):
        solve(h, g)
    l, d = factor(h[np.ix_(keep, keep)])
    assert np.allclose(l @ np.diag(d) @ l.T, h[np.ix_(keep, keep)]) and (inverse(np.zeros((2, 2))) == 0).all()


def test_aliased_terms(spark):
    df = _odd_table(spark, 3).withColumn("twice", 2 * F.col("a") + 7)
    for rows in (0, 10**6):
        m = cox.cox("Surv(start, stop, event) ~ a + twice + c", df, singular_ok=True, driver_rows=rows)
        k = cox.cox("Surv(start, stop, event) ~ a + c", df)
        assert m.aliased == (False, True, False) and m.df == 2 and np.allclose(m.coef, [k.coef[0], 0, k.coef[1]], atol=1e-7)
        assert math.isclose(m.aic(), k.aic(), rel_tol=1e-9) and np.allclose(m.tests()["wald"], k.tests()["wald"]) and m.tests()["df"] == 2
        s = {r.term: r for r in m.summary(spark).collect()}
        assert math.isnan(s["twice"].coef) and math.isnan(s["twice"].p) and math.isclose(s["c"].se, k.se[1], rel_tol=1e-6)
        with pytest.raises(Singular):
            cox.cox("Surv(start, stop, event) ~ a + twice + c", df, driver_rows=rows)


def test_designs(spark):
    rows = [(1, 0, 1.5, "x", True, 3), (2, 1, 2.5, "y", False, 1), (3, 1, 0.5, "z", True, 2), (4, 0, None, "q", False, 9), (5, 1, 1.0, "x", None, 1)]
    df = spark.createDataFrame(rows, "time int, status int, a double, g string, b boolean, k int")
    of = lambda text: design(parse(f"Surv(time, status) ~ {text}", df.columns), df)
    d = of("a + g")  # the row without a has the only q
    assert d.labels == ("a", "gy", "gz") and d.names == ["a", "__x2", "__x3"]
    got = {r.time: (r.a, r["__x2"], r["__x3"]) for r in d.matrix(df).collect()}
    assert got[1] == (1.5, 0, 0) and got[2] == (2.5, 1, 0) and got[3] == (0.5, 0, 1) and got[4] == (None, None, None)
    assert of("a * b").labels == ("a", "bTrue", "a:bTrue") and of("a:g").labels == ("a:gx", "a:gy", "a:gz") and of("a + a:g").labels == ("a", "a:gy", "a:gz")
    assert of("g:b").labels == ("gq:bFalse", "gx:bFalse", "gy:bFalse", "gz:bFalse", "gq:bTrue", "gx:bTrue", "gy:bTrue", "gz:bTrue")
    assert of("factor(k)").labels == ("factor(k)2", "factor(k)3", "factor(k)9") and of("a*factor(k) - a:factor(k)").labels == ("a", "factor(k)2", "factor(k)3")
    assert of("a + offset(k)").offset == "k" and of("offset(k) + a").labels == ("a",) and of("a - 1").labels == ("a",)
    assert set(of("a*b*k").labels) == {"a", "bTrue", "k", "a:bTrue", "a:k", "bTrue:k", "a:bTrue:k"}
    with pytest.raises(ValueError, match="factors and numbers"):
        of("k + factor(k)")
    with pytest.raises(ValueError):
        cox.cox("Surv(time, status) ~ offset(a)", df)


def test_design_of_text_is_that_of_indicators(spark):
    df = _odd_table(spark, 8, 200).withColumn("g", F.when(F.col("c") > 0.4, "hi").when(F.col("c") < -0.4, "lo").otherwise("mid"))
    m = cox.cox("Surv(start, stop, event) ~ a * g", df)
    by_hand = df.withColumns({"lo": (F.col("g") == "lo").cast("int"), "mid": (F.col("g") == "mid").cast("int")})
    by_hand = by_hand.withColumns({"alo": F.col("a") * F.col("lo"), "amid": F.col("a") * F.col("mid")})
    k = cox.cox_fit(by_hand, ["a", "lo", "mid", "alo", "amid"])
    assert m.covariates == ("a", "glo", "gmid", "a:glo", "a:gmid") and np.allclose(m.coef, k.coef, rtol=1e-6)
    got = m.linear_predictor(df).select("a", "g", "lp").collect()
    assert "__x2" not in m.linear_predictor(df).columns and all(r.lp is not None for r in got)
    boot = cox.cox_bootstrap("Surv(start, stop, event) ~ a * g", df, 2, all_results=True)
    assert {r.term for r in boot.fits.collect()} == set(m.covariates)


def _counted(spark, df):
    """df, and an accumulator of the rows that are read from it, over all jobs."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(read, df.schema), seen


@pytest.mark.parametrize("work,most", [
    (lambda d: riskset.concordance(d, "risk"), 1), (lambda d: riskset.concordance_error(d, "risk"), 1), (lambda d: riskset.hazards(d), 1), (lambda d: riskset.martingale(d), 3), (lambda d: panel.ever_at_risk(d), 3),
])
def test_the_source_is_read_few_times(spark, days, work, most):
    rows = days.withColumn("risk", F.exp(0.1 * F.col("age"))).select("id", "start", "stop", "event", "risk")
    df, seen = _counted(spark, rows)
    work(df).count()
    assert 0 < seen.value <= most * rows.count()


def test_ranges_are_balanced_whatever_the_values(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 3, F.lit(-1e15) * (F.col("id") + 1)).otherwise(1e6 + F.col("id") / 1e6).alias("t"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ordered.ranges(rows, ["t"]).groupBy("__range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 6 and max(sizes) < 2 * 20_000 / len(sizes)
    got = ordered.numbered(rows, ["t"], "n").orderBy("t").collect()
    assert [r.n for r in got] == list(range(20_000))


def test_doses_meet_rows_in_buckets(spark, days):
    for df, key in ((exposure.wce_features(days, 7), "__bucket"), (panels.true_exposure(days, "bilinear"), "__bucket")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        join = re.search(rf"Join \[id#\d+L?, {key}#\d+L?\]", plan)
        assert join and "Exchange" not in plan[: join.start()]
    # a row of a long history meets the doses of its window and of one more bucket at most
    long_ = spark.range(5000).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("stop"), F.lit(1.0).alias("dose"))
    source = long_.select("id", F.col("stop").alias("__s"), "dose")
    pairs = exposure.within_reach(long_.select("id", "stop"), source, ["id"], "stop", 10)
    assert pairs.count() == 10 * 5000 - 45 and pairs.groupBy("__bucket").count().agg(F.max("count")).first()[0] <= 100
    got = {r.stop: r.D1 for r in exposure.features(long_, np.ones((10, 1))).collect()}
    assert all(got[t] == min(10, t + 1) for t in range(5000))


@settings(deadline=None, max_examples=3, derandomize=True)
@given(st.lists(st.tuples(st.integers(-40, 40), st.integers(0, 3)), min_size=1, max_size=25, unique_by=lambda r: r[0]))
def test_features_of_any_times(spark, drawn):
    values = splines.atoms(9)
    rows = spark.createDataFrame([(1, t, float(d)) for t, d in drawn], "id int, stop int, dose double")
    got = {r.stop: r for r in exposure.features(rows, values).collect()}
    for t, _ in drawn:
        want = sum(d * values[t - s] for s, d in drawn if 0 <= t - s < 9)
        assert np.allclose([got[t][f"D{k + 1}"] for k in range(values.shape[1])], want)


def test_cohorts_of_a_table(spark):
    ev = panels.events(spark, SF)
    doses = panels.observed_doses(ev, ["click", "view"])
    seen = {(r.id, r.day) for r in ev.where("event_type = 'click'").collect()}
    rows = doses.where("drug = 0").collect()
    assert all(r.dose == ((r.patient, r.t) in seen) for r in rows) and len(rows) == panels.person_days(spark, SF).count()
    out = panels.dose_outcomes(doses.where("drug = 0"), 30, 2).collect()
    taken = {(r.patient, r.t) for r in rows if r.dose}
    hits = [r for r in out if r.event % 2]
    assert hits and all((r.patient, r.t - 1) in taken and (r.patient, r.t - 2) in taken for r in hits)
    frame = panels.random_frame(panels.subjects(ev), 50, 2)
    assert frame.select("id").distinct().count() == 150 and frame.agg(F.max("time"), F.min("time")).first()[0] <= 50


def test_draws_split_over_blocks(spark):
    rows, block = 1000, 64
    draws = resample.SplitDraws(rows, block, 3)
    parts = -(-rows // block)
    counts = np.array([[draws.count(p, b) for p in range(parts)] for b in range(400)])
    assert (counts.sum(1) == rows).all() and counts[0].tolist() == [64] * 15 + [40]
    # of multinomial law: means, variances and covariances of the blocks
    share = np.array([64] * 15 + [40]) / rows
    assert np.allclose(counts[1:].mean(0), rows * share, rtol=0.05) and np.allclose(counts[1:].var(0), rows * share * (1 - share), rtol=0.35)
    assert abs(np.cov(counts[1:, 0], counts[1:, 1])[0, 1] + rows * share[0] * share[1]) < 15
    again = resample.SplitDraws(rows, block, 3)  # another task, in another order
    assert [again.count(p, 7) for p in reversed(range(parts))] == counts[7][::-1].tolist()
    w = np.concatenate([draws.weights(p, 5) for p in range(parts)])
    assert w.sum() == rows and abs((w == 0).mean() - math.exp(-1)) < 0.06
    assert (resample.SplitDraws(500, 4096, 7).weights(0, 2) == resample.draws_of(500, 2, 7)).all()


def test_split_bootstrap_keeps_rows_and_shuffles_no_draws(spark, days):
    one = resample.split_bootstrap(days, 3, keep=["id", "stop"])
    want = resample.row_bootstrap(days.select("id", "stop"), 3)
    assert sorted(one.select("id", "stop", "b", "w").collect()) == sorted(want.select("id", "stop", "b", "w").collect())
    many = resample.split_bootstrap(days, 4, keep=["stop", "event", "sex"], block=500)
    got = many.groupBy("b").agg(F.sum("w").alias("n")).collect()
    assert sorted(r.b for r in got) == [0, 1, 2, 3] and all(r.n == days.count() for r in got)
    sample = many.where("b = 0").groupBy("stop", "event", "sex").agg(F.sum("w").alias("n"))
    assert sorted(sample.collect()) == sorted(days.groupBy("stop", "event", "sex").count().collect())
    sliced = resample.split_bootstrap(days, 4, keep=["stop", "event", "sex"], block=500, at_once=3)
    assert sorted(sliced.collect()) == sorted(many.collect())
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("FlatMapGroupsInArrow")[0] and "Exchange" not in plan.split("FlatMapGroupsInArrow")[0]


def test_wide_designs(spark):
    r = np.random.default_rng(4)
    n, d = 300, 24
    x = r.normal(size=(n, d)) + 1000
    rows = [(int(s), int(s + 1 + k), int(e), str(g), *map(float, v)) for s, k, e, g, v in zip(r.integers(0, 5, n), r.integers(0, 4, n), r.random(n) < 0.6, r.integers(0, 2, n), x)]
    names = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame(rows, "start int, stop int, event int, g string, " + ", ".join(f"{c} double" for c in names)).persist()
    beta = r.normal(size=d) / 3
    for start, ties, by in ((None, "efron", []), ("start", "breslow", ["g"])):
        small = riskset.compact(df, names, start=start, by=by)
        table = small.toPandas()
        parts = [t for _, t in table.groupby("g")] if by else [table]
        f, g, h = cox.of_strata([Kernel(t["stop"], t["event"], t[names], t["n"], t[start] if start else None, ties) for t in parts], 0.2)(beta)
        centred = small.withColumns({c: F.col(c) - 1000.0 for c in names})
        found = cox.evaluate_wide(riskset.cover(centred, names, "stop", "event", start, by) if start else centred, names, beta, "stop", "event", ties, 0.2, by=by)
        assert math.isclose(f, found[0], rel_tol=1e-9) and np.allclose(g, found[1], rtol=1e-7, atol=1e-7) and np.allclose(h, found[2], rtol=1e-6, atol=1e-6), (start, ties)
    a, b = (cox.cox_fit(df, names, driver_rows=k, maxiter=2) for k in (0, 10**6))
    assert np.allclose(a.coef, b.coef, atol=1e-7) and np.allclose(a.se, b.se, rtol=1e-6)
    df.unpersist()


def test_strata_have_their_own_risk_sets(spark):
    df = _odd_table(spark, 6).withColumn("g", F.when(F.col("c") > 0, "u").otherwise("v")).persist()
    for options in ({}, {"start": "start", "risk_set": "interval", "alpha": 0.1}):
        m, s = (cox.cox_fit(df, ["a"], strata="g", driver_rows=k, **options) for k in (10**6, 0))
        # strata as times that don't meet
        apart = df.withColumns({c: F.col(c) + F.when(F.col("g") == "u", 1000).otherwise(0) for c in ("start", "stop")})
        k = cox.cox_fit(apart, ["a"], **options)
        assert np.allclose([m.coef[0], m.loglik, m.se[0]], [k.coef[0], k.loglik, k.se[0]], rtol=1e-7) and np.allclose(s.coef, m.coef, atol=1e-8)
    df.unpersist()


def test_stacked_transitions(spark):
    rows = [(0, 2, "a", "b", 1.0, 5.0), (0, 3, "a", None, 2.0, 6.0), (2, 4, "b", "a", 3.0, 7.0), (1, 5, None, "a", 4.0, 8.0), (1, 5, "c", "a", 4.0, 8.0)]
    df = spark.createDataFrame(rows, "start int, stop int, state string, after string, x double, z double")
    ts = [Transition("a", "b", {"x": "x", "z": "z"}), Transition("a", "c", ["x"]), Transition("b", "a", {"z": "x"})]
    assert coefficients(ts) == ["x", "z", "x_a:c"]
    got = sorted(map(tuple, stack(df, ts).collect()))
    assert got == sorted([(0, 2, "a:b", 1, 1.0, 5.0, 0.0), (0, 2, "a:c", 0, 0.0, 0.0, 1.0), (0, 3, "a:b", 0, 2.0, 6.0, 0.0), (0, 3, "a:c", 0, 0.0, 0.0, 2.0), (2, 4, "b:a", 1, 7.0, 0.0, 0.0)])
    with pytest.raises(ValueError):
        stack(df, [ts[0], ts[0]])


def test_losses_over_a_table(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=300)
    y = (r.random(300) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b), 1 + i % 3) for i, (a, b) in enumerate(zip(x, y))] + [(None, 1, 1)], "x double, y int, w int")
    m = losses.fit(df, "y", ["x"], weight="w")
    p = 1 / (1 + np.exp(-(m.coef[0] + m.coef[1] * x)))
    w = 1 + np.arange(300) % 3
    assert np.allclose([(w * (p - y)).sum(), (w * (p - y) * x).sum()], 0, atol=1e-6)
    assert math.isclose(m.loglik, (w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum(), rel_tol=1e-9)
    q = losses.fit(df, "y", ["x"], losses.poisson)
    assert abs((np.exp(q.coef[0] + q.coef[1] * x) - y).sum()) < 1e-6
    huge = losses.logistic("y", ["x"])({"y": np.array([0.0, 1.0]), "x": np.array([1e6, -1e6])}, np.array([0.0, 1.0]))
    assert np.isfinite(huge[0]) and np.isfinite(huge[1]).all()
    found = losses.minimise(df, ["x"], lambda rows, b: (float(((rows["x"] - b[0]) ** 2).sum()), np.array([-2 * (rows["x"] - b[0]).sum()]), np.array([[2.0 * len(rows["x"])]])), [3.0])
    assert math.isclose(found.beta[0], x.mean(), rel_tol=1e-9)
