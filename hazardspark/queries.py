"""Registered queries of the survival engine on the driver's tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardspark import oracle
from hazardspark.functions import splines
from hazardspark.operators import exposure, ordered, panel, resample, riskset
from hazardspark.plans import cox, losses, multistate, replicates, wce
from hazardspark.sources import panels
from hazardspark.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Exposure channels of the multi-exposure queries; the dose window and knots of the exposure queries.
CHANNELS = ("click", "view", "error", "signup")
CUTOFF, KNOTS = 7, 1
#: Coefficients of sex and age at which likelihoods are evaluated.
BETA = (-0.2, 0.004)
#: Added before rounding sums of products of short decimals, which often end in a 5 just there.
TIE = 1.7e-8

EVENTS_SQL = """ev AS (
    SELECT user_id AS id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS day, event_type, value FROM events),
subj AS (
    SELECT id, coalesce(min(CASE WHEN event_type = 'purchase' AND value >= 150 THEN day END), 30) AS follow_up,
        max(CASE WHEN event_type = 'purchase' AND value >= 150 THEN 1 ELSE 0 END) AS status
    FROM ev GROUP BY id)"""
PANEL_SQL = EVENTS_SQL + """,
dosed AS (SELECT id, day, sum(value) / 100 AS dose FROM ev WHERE event_type = 'click' GROUP BY id, day),
panel AS (
    SELECT s.id, CAST(d.day - 1 AS INTEGER) AS start, CAST(d.day AS INTEGER) AS stop,
        CAST(CASE WHEN d.day = s.follow_up AND s.status = 1 THEN 1 ELSE 0 END AS INTEGER) AS event,
        coalesce(x.dose, 0.0) AS dose, CAST(s.id % 2 AS INTEGER) AS sex, CAST(20 + (s.id * 7) % 50 AS INTEGER) AS age
    FROM subj s, generate_series(1, 30) d(day) LEFT JOIN dosed x ON x.id = s.id AND x.day = d.day
    WHERE d.day <= s.follow_up)"""
DEATHS_SQL = "deaths AS (SELECT stop AS t, count(*) AS n FROM panel WHERE event = 1 GROUP BY stop)"


def query(sql: str | None = None, base: str = PANEL_SQL) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {base}" + (f", {body[5:]}" if body.startswith("WITH ") else f" {body}")
        return f

    return add


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.person_days(spark, sf_dir)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    # adding 0.0 turns a rounded -0.0 into 0.0
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- sources, filters, projections


@query("SELECT id, start, stop, event, round(dose, 6) + 0.0 AS dose, sex, age FROM panel")
def panel_expand(spark, sf_dir):
    return _rounded(_panel(spark, sf_dir))


@query("SELECT id, stop, round(dose, 6) + 0.0 AS dose FROM panel WHERE dose <> 0")
def zero_dose_filter(spark, sf_dir):
    return _rounded(_panel(spark, sf_dir).where("dose <> 0").select("id", "stop", "dose"))


def _with_nulls(df: DataFrame) -> DataFrame:
    return df.select("id", "stop", "event", F.expr("CASE WHEN (id + stop) % 7 <> 0 THEN age END").alias("age"), F.expr("CASE WHEN stop % 3 <> 0 THEN sex END").alias("sex"))


NULLS_SQL = "n AS (SELECT id, stop, event, CASE WHEN (id + stop) % 7 <> 0 THEN age END AS age, CASE WHEN stop % 3 <> 0 THEN sex END AS sex FROM panel)"


@query(f"WITH {NULLS_SQL} SELECT * FROM n WHERE age IS NOT NULL")
def na_drop(spark, sf_dir):
    return panel.drop_missing(_with_nulls(_panel(spark, sf_dir)), ["stop", "event", "age"])


@query(f"WITH {DEATHS_SQL} SELECT id, stop, event FROM panel WHERE stop IN (SELECT t FROM deaths)")
def death_time_filter(spark, sf_dir):
    return panel.at_death_times(_panel(spark, sf_dir)).select("id", "stop", "event")


@query(f"WITH {DEATHS_SQL} SELECT id, stop, event, n AS deaths FROM panel JOIN deaths ON stop = t")
def death_time_join(spark, sf_dir):
    df = _panel(spark, sf_dir)
    return df.join(panel.death_times(df), "stop").select("id", "stop", "event", "deaths")


def _weekly(df: DataFrame) -> DataFrame:
    """Unsplit intervals: a subject's days of each calendar week."""
    week = F.floor((F.col("stop") - 1) / 7)
    return df.groupBy("id", "sex", "age", week.alias("week")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("event").alias("event")).drop("week")


WEEKLY_SQL = "weekly AS (SELECT id, sex, age, min(start) AS start, max(stop) AS stop, max(event) AS event FROM panel GROUP BY id, sex, age, (stop - 1) // 7)"


@query(f"WITH {WEEKLY_SQL}, late AS (SELECT * FROM weekly WHERE event = 1 AND stop > 10) SELECT id, start, stop FROM weekly w WHERE EXISTS (SELECT 1 FROM late WHERE w.start < late.stop AND late.stop <= w.stop)")
def never_at_risk_filter(spark, sf_dir):
    # only deaths after day 10 count here, so that some intervals cover none
    rows = _weekly(_panel(spark, sf_dir)).withColumn("event", F.when(F.col("stop") > 10, F.col("event")).otherwise(0))
    return panel.ever_at_risk(rows).select("id", "start", "stop")


@query(f"""WITH {WEEKLY_SQL}, cuts AS (SELECT DISTINCT stop AS t FROM weekly WHERE event = 1),
    points AS (SELECT id, start, stop, event, unnest(list_sort(list_distinct(list_concat([stop], coalesce((SELECT list(t) FROM cuts WHERE weekly.start < t AND t < weekly.stop), CAST([] AS INTEGER[])))))) AS e FROM weekly)
    SELECT id, coalesce(lag(e) OVER (PARTITION BY id, start ORDER BY e), start) AS start, e AS stop, CASE WHEN e = stop THEN event ELSE 0 END AS event FROM points""")
def split_at_death_times(spark, sf_dir):
    rows = _weekly(_panel(spark, sf_dir)).select("id", "start", "stop", "event")
    return panel.split_at(rows, panel.death_times(rows).select("stop"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = panels.events(spark, sf_dir).where("event_type = 'purchase'").groupBy("id", "day").agg(F.max((F.col("value") >= 150).cast("int")).alias("event"))
    return panel.flag_after_event(ev, "id", "day", "event")


FLAG_SQL = """b AS (SELECT id, day, max(CASE WHEN value >= 150 THEN 1 ELSE 0 END) AS event FROM ev WHERE event_type = 'purchase' GROUP BY id, day),
    flagged AS (SELECT id, day, CAST(event + 2 * coalesce(sum(event) OVER (PARTITION BY id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS event FROM b)"""


@query(f"WITH {FLAG_SQL} SELECT * FROM flagged", EVENTS_SQL)
def post_event_flag(spark, sf_dir):
    return _flagged(spark, sf_dir)


@query(f"WITH {FLAG_SQL} SELECT * FROM flagged WHERE event <= 1", EVENTS_SQL)
def after_event_filter(spark, sf_dir):
    return panel.up_to_event(_flagged(spark, sf_dir))


@query("SELECT id, stop, round(-0.2 * sex + 0.004 * age, 6) + 0.0 AS lp FROM panel")
def linear_predictor(spark, sf_dir):
    return _rounded(_panel(spark, sf_dir).select("id", "stop", riskset.predictor(["sex", "age"], BETA).alias("lp")))


@query("SELECT id, stop, round(exp(-0.2 * sex + 0.004 * (age - (SELECT avg(age) FROM panel))), 6) AS risk FROM panel")
def centred_risk_score(spark, sf_dir):
    df = _panel(spark, sf_dir)
    means = df.agg(F.avg("sex"), F.avg("age")).first()
    zero = np.zeros(2)
    model = cox.CoxModel(("sex", "age"), np.array(BETA), np.eye(2), 0.0, 0.0, 0.0, zero, np.array(list(means)), 1, 1, "efron")
    return _rounded(model.risk(df).select("id", "stop", "risk"))


@query("WITH m AS (SELECT avg(age) AS mean FROM panel), s AS (SELECT sum(abs(age - mean)) AS total FROM panel, m) SELECT id, stop, round((age - mean) / total * 1e6, 6) + 0.0 AS age_scaled FROM panel, m, s")
def scaled_covariate(spark, sf_dir):
    return _rounded(cox.scaled(_panel(spark, sf_dir), "age", "age_scaled", 1e6).select("id", "stop", "age_scaled"))


@query("""WITH ends AS (SELECT id, round(sum(dose), 6) AS total FROM panel GROUP BY id), u AS (SELECT DISTINCT total AS t FROM ends),
    c AS (SELECT t, sum(CASE WHEN round(t - l, 9) < 0.001 THEN 0 ELSE 1 END) OVER (ORDER BY t) AS g FROM (SELECT t, lag(t) OVER (ORDER BY t) AS l FROM u) q), m AS (SELECT t, min(t) OVER (PARTITION BY g) AS merged FROM c)
    SELECT id, round(merged, 4) AS merged FROM ends JOIN m ON total = t""")
def tie_repair(spark, sf_dir):
    # sums of decimals in any order are one number
    totals = _panel(spark, sf_dir).groupBy("id").agg(F.round(F.sum("dose"), 6).alias("merged"))
    return _rounded(panel.merge_times(totals, "merged", 3), 4)


@query("SELECT id, day, CAST(event_type = 'click' AS INTEGER) AS event_type_click, CAST(event_type = 'error' AS INTEGER) AS event_type_error FROM ev", EVENTS_SQL)
def one_hot(spark, sf_dir):
    return panel.one_hot(panels.events(spark, sf_dir), "event_type", ["view", "click", "error"]).select("id", "day", "event_type_click", "event_type_error")


# --- joins


@query(f"WITH {WEEKLY_SQL}, t AS (SELECT DISTINCT stop AS t FROM weekly WHERE event = 1) SELECT t, id FROM weekly JOIN t ON start < t AND t <= stop")
def riskset_members(spark, sf_dir):
    return riskset.members(_weekly(_panel(spark, sf_dir)))


@query("""WITH e AS (SELECT id, day, max(value) AS value FROM ev WHERE event_type = 'error' GROUP BY id, day)
    SELECT p.id, p.stop, round(e.value, 6) AS last_error FROM panel p ASOF LEFT JOIN e ON p.id = e.id AND p.stop >= e.day""")
def asof_last(spark, sf_dir):
    new = panels.events(spark, sf_dir).where("event_type = 'error'").groupBy("id", "day").agg(F.max("value").alias("value"))
    return _rounded(panel.merge_last(_panel(spark, sf_dir).select("id", "stop"), new, "id", "stop", "day", "value", "last_error"))


@query("""SELECT p.id, p.stop, coalesce((SELECT count(*) FROM ev WHERE ev.id = p.id AND ev.day <= p.stop), 0) AS events_so_far FROM panel p""")
def cumulative_merge(spark, sf_dir):
    new = panels.events(spark, sf_dir).withColumn("one", F.lit(1).cast("long"))
    return panel.merge_cumulative(_panel(spark, sf_dir).select("id", "stop"), new, "id", "stop", "day", "one", "events_so_far")


#: Columns that a right constraint leaves of the five splines of a single inner knot, and a left one.
RIGHT, LEFT = (0, 1, 2), (2, 3, 4)


def _feature_query(name: str, count: int, kept: tuple[int, ...] | None = None, **options) -> None:
    def run(spark, sf_dir):
        found = exposure.wce_features(_panel(spark, sf_dir), **options)
        return _rounded(found.select("id", "stop", *[(F.col(c) + TIE).alias(c) for c in found.columns[2:]]), 5)

    run.__name__ = name
    columns = ", ".join(f"round(D{k + 1} + {TIE}, 5) + 0.0 AS D{k + 1}" for k in range(count))
    query(f"WITH {oracle.atoms_sql(options['cutoff'], options['nknots'], kept)}, {oracle.features_sql(count, options['cutoff'])} SELECT id, stop, {columns} FROM feat")(run)


_feature_query("wce_features", 5, cutoff=CUTOFF, nknots=KNOTS)
_feature_query("wce_features_right", 3, RIGHT, cutoff=CUTOFF, nknots=KNOTS, constrained="Right")
_feature_query("wce_features_left", 3, LEFT, cutoff=CUTOFF, nknots=KNOTS, constrained="left")
_feature_query("wce_features_3_knots", 7, cutoff=10, nknots=3)


#: The published weight functions of a lag in years (u) or in days from 1 (d), in DuckDB's words (fixed values).
WEIGHTS_SQL = {
    "exponential": "7 * exp(-7 * u)",
    "bilinear": "CASE WHEN u <= 50 / 365.0::DOUBLE THEN 1 - u / (50 / 365.0::DOUBLE) ELSE 0 END",
    "early_peak": "exp(-power((d / 365.0::DOUBLE - 0.04) / 0.05, 2) / 2) / 0.05 / sqrt(2 * pi()) / 365",
    "inverted_u": "exp(-power((d / 365.0::DOUBLE - 0.2) / 0.06, 2) / 2) / 0.06 / sqrt(2 * pi()) / 365",
    "constant": "CASE WHEN u >= 0 AND u <= 180 / 365.0::DOUBLE THEN 1 / 180.0::DOUBLE ELSE 0 END",
}


def _weight_query(shape: str) -> None:
    def run(spark, sf_dir):
        # days of the panel count as a week each, so that its month covers the functions
        return _rounded(panels.true_exposure(_panel(spark, sf_dir), shape, 7.0).withColumn("wce", F.col("wce") + TIE))

    run.__name__ = f"true_wce_{shape}"
    query(f"""WITH src AS (SELECT id, stop AS s, dose FROM panel WHERE dose <> 0),
        far AS (SELECT p.id, p.stop, s.dose, (p.stop - s.s) * 7.0::DOUBLE / 365 AS u, (p.stop - s.s) * 7.0::DOUBLE + 1 AS d FROM panel p LEFT JOIN src s ON s.id = p.id AND s.s <= p.stop)
        SELECT id, stop, round(coalesce(sum(dose * ({WEIGHTS_SQL[shape]})), 0.0) + {TIE}, 6) + 0.0 AS wce FROM far GROUP BY id, stop""")(run)


for _shape in WEIGHTS_SQL:
    _weight_query(_shape)


# --- aggregations


@query(f"WITH {DEATHS_SQL} SELECT t AS stop, n AS deaths FROM deaths")
def tied_deaths(spark, sf_dir):
    return panel.death_times(_panel(spark, sf_dir))


@query("SELECT stop, round(ln(sum(exp(-0.2 * sex + 0.004 * age))), 6) AS lse FROM panel GROUP BY stop")
def group_logsumexp(spark, sf_dir):
    df = _panel(spark, sf_dir).select("stop", riskset.predictor(["sex", "age"], BETA).alias("lp"))
    return _rounded(riskset.log_sum_exp(df, ["stop"], "lp"))


@query("SELECT count(*) AS n, CAST(sum(event) AS BIGINT) AS n_events, round(avg(sex), 6) AS mean_sex, round(avg(age), 6) AS mean_age FROM panel")
def covariate_means(spark, sf_dir):
    return _rounded(_panel(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("event").alias("n_events"), F.avg("sex").alias("mean_sex"), F.avg("age").alias("mean_age")))


def _fit_rows_sql(covariates: list[str], rounds: int = 8) -> str:
    """term, coef, se, loglik_init, loglik, score of the last iteration."""
    return f"SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(loglik_init, 5) AS loglik_init, round(loglik, 5) AS loglik, round(score, 5) AS score FROM ({oracle.fits_sql(covariates, rounds)}) q"


def _fit_rows(spark: SparkSession, model: cox.CoxModel) -> DataFrame:
    rows = [(t, round(float(b), 6), round(float(s), 6), round(model.loglik_init, 5), round(model.loglik, 5), round(model.score, 5)) for t, b, s in zip(model.covariates, model.coef, model.se)]
    return spark.createDataFrame(rows, "term string, coef double, se double, loglik_init double, loglik double, score double")


def _fit_query(name: str, covariates: list[str], ties: str = "efron", alpha: float = 0.0, **options) -> None:
    def run(spark, sf_dir):
        return _fit_rows(spark, cox.cox_fit(_panel(spark, sf_dir), covariates, ties=ties, alpha=alpha, **options))

    run.__name__ = name
    query(f"WITH {oracle.newton_sql(covariates, ties, alpha)} {_fit_rows_sql(covariates)}")(run)


_fit_query("cox_efron_1", ["sex"])
_fit_query("cox_efron_2", ["sex", "age"])
_fit_query("cox_breslow_2", ["sex", "age"], "breslow")
_fit_query("cox_ridge", ["sex", "age"], alpha=0.1)
_fit_query("cox_interval", ["sex", "age"], start="start", risk_set="interval")
_fit_query("cox_doscale", ["sex", "age"], doscale=True)
_fit_query("cox_distributed", ["sex", "age"], driver_rows=0)


@query(f"WITH {oracle.newton_sql(['sex', 'age'])} {_fit_rows_sql(['sex', 'age'])}")
def cox_formula(spark, sf_dir):
    return _fit_rows(spark, cox.cox("Surv(start, stop, event) ~ sex + age", _panel(spark, sf_dir)))


#: The weekly intervals once for each death time that they cover, as rows that stop there.
COVERED_SQL = WEEKLY_SQL + ", dt AS (SELECT DISTINCT stop AS t FROM weekly WHERE event = 1), covered AS (SELECT t AS stop, CASE WHEN event = 1 AND stop = t THEN 1 ELSE 0 END AS event, sex, age FROM weekly JOIN dt ON start < t AND t <= stop)"
#: One row a subject, with follow-up and status, and the same for each death time that it covers.
ONCE_SQL = "once AS (SELECT id, max(stop) AS time, max(event) AS status, max(sex) AS sex, max(age) AS age FROM panel GROUP BY id)"
ONCE_COVERED_SQL = ONCE_SQL + ", dt AS (SELECT DISTINCT time AS t FROM once WHERE status = 1), covered AS (SELECT t AS stop, CASE WHEN status = 1 AND time = t THEN 1 ELSE 0 END AS event, sex, age FROM once JOIN dt ON t <= time)"


@query(f"WITH {COVERED_SQL}, {oracle.newton_sql(['sex', 'age'], table='covered')} {_fit_rows_sql(['sex', 'age'])}")
def cox_interval_unsplit(spark, sf_dir):
    return _fit_rows(spark, cox.cox("Surv(start, stop, event) ~ sex + age", _weekly(_panel(spark, sf_dir)), risk_set="interval"))


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, status and covariates of each subject, without the subject: many rows are equal."""
    rows = _panel(spark, sf_dir).groupBy("id").agg(*[F.max(c).alias(n) for c, n in (("stop", "time"), ("event", "status"), ("sex", "sex"), ("age", "age"))])
    return rows.select("time", "status", "sex", "age")


@query(f"WITH {ONCE_COVERED_SQL}, {oracle.newton_sql(['sex'], table='covered')} {_fit_rows_sql(['sex'])}")
def cox_right_censored(spark, sf_dir):
    return _fit_rows(spark, cox.cox("Surv(time, status) ~ sex", _once(spark, sf_dir)))


@query(f"WITH {ONCE_COVERED_SQL}, {oracle.newton_sql(['sex'], 'breslow', table='covered', weight='1')} {_fit_rows_sql(['sex'])}")
def cox_weighted_rows(spark, sf_dir):
    # equal rows as one with their number as weight
    rows = _once(spark, sf_dir).groupBy("time", "status", "sex").agg(F.count("*").alias("w"))
    return _fit_rows(spark, cox.cox("Surv(time, status) ~ sex", rows, ties="breslow", weight="w"))


PAIR_FITS_SQL = f"{oracle.newton_sql(['sex', 'age'])}, fits AS MATERIALIZED ({oracle.fits_sql(['sex', 'age'])})"


def _large(df: DataFrame) -> DataFrame:
    """Covariates far from zero, whose exponentials overflow unless sums find their own scale."""
    return df.select("id", "start", "stop", "event", "sex", (F.col("age") + 200_000).alias("year"), (-3 * F.col("age") - 90_000).alias("below"))


#: The same covariates about their means, where SQL can take exponentials; coefficients are the same.
LARGE_SQL = "lg AS (SELECT id, start, stop, event, sex, age - (SELECT avg(age) FROM panel) AS year FROM panel)"


@query(f"WITH {LARGE_SQL}, {oracle.newton_sql(['sex', 'year'], table='lg')} {_fit_rows_sql(['sex', 'year'])}")
def cox_large_covariates(spark, sf_dir):
    return _fit_rows(spark, cox.cox_fit(_large(_panel(spark, sf_dir)), ["sex", "year"], driver_rows=0))


@query(f"WITH {LARGE_SQL}, {oracle.newton_sql(['sex', 'year'], 'breslow', table='lg')} {_fit_rows_sql(['sex', 'year'])}")
def cox_interval_distributed(spark, sf_dir):
    return _fit_rows(spark, cox.cox_fit(_large(_panel(spark, sf_dir)), ["sex", "year"], start="start", ties="breslow", risk_set="interval", driver_rows=0))


@query(f"""WITH {PAIR_FITS_SQL}
    SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(loglik, 5) AS loglik, 2 AS df FROM fits UNION ALL SELECT 'below', NULL, NULL, round(loglik, 5), 2 FROM fits WHERE term = 'sex'""")
def cox_aliased_term(spark, sf_dir):
    m = cox.cox_fit(_large(_panel(spark, sf_dir)).withColumn("age", F.col("year") - 200_000), ["sex", "age", "below"], singular_ok=True)
    rows = [(t, None if b != b else round(b, 6), None if b != b else round(float(s), 6), round(m.loglik, 5), m.df) for (t, b), s in zip(m.coefficients().items(), m.se)]
    return spark.createDataFrame(rows, "term string, coef double, se double, loglik double, df int")


DESIGN_SQL = """ds AS (SELECT stop, event, sex AS c1, CAST(id % 3 = 1 AS INTEGER) AS c2, CAST(id % 3 = 2 AS INTEGER) AS c3, sex * CAST(id % 3 = 1 AS INTEGER) AS c4, sex * CAST(id % 3 = 2 AS INTEGER) AS c5, age / 100.0::DOUBLE AS z FROM panel)"""


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).withColumn("band", F.col("id") % 3).withColumn("z", F.col("age") / 100)


@query(f"""WITH {DESIGN_SQL}, {oracle.newton_sql(['c1', 'c2', 'c3', 'c4', 'c5'], table='ds', offset='z')}, q AS ({_fit_rows_sql(['c1', 'c2', 'c3', 'c4', 'c5'])})
    SELECT l.label AS term, q.* EXCLUDE (term) FROM q JOIN (VALUES ('c1', 'sex'), ('c2', 'factor(band)1'), ('c3', 'factor(band)2'), ('c4', 'sex:factor(band)1'), ('c5', 'sex:factor(band)2')) l(term, label) USING (term)""")
def cox_factors_and_offset(spark, sf_dir):
    return _fit_rows(spark, cox.cox("Surv(start, stop, event) ~ sex * factor(band) + offset(z)", _banded(spark, sf_dir)))


@query("SELECT 'sex' AS term, 0.0::DOUBLE AS coef UNION ALL SELECT 'age', 0.0::DOUBLE")
def cox_one_iteration(spark, sf_dir):
    m = cox.cox_fit(_panel(spark, sf_dir), ["sex", "age"], maxiter=1)
    return spark.createDataFrame([(t, float(b)) for t, b in zip(m.covariates, m.coef)], "term string, coef double")


def _regression_query(name: str, kind: str, y: str, y_sql: str) -> None:
    def run(spark, sf_dir):
        p = _panel(spark, sf_dir).withColumn("y", F.expr(y)).withColumn("older", F.col("age") / 50)
        m = losses.fit(p, "y", ["sex", "older"], getattr(losses, kind))
        rows = [(t, round(float(b), 6), round(float(s), 6), round(m.loglik, 4), round(m.score, 4)) for t, b, s in zip(m.terms, m.coef, m.se)]
        return spark.createDataFrame(rows, "term string, coef double, se double, loglik double, score double")

    run.__name__ = name
    query(f"""WITH {oracle.regression_sql(y_sql, ['1', 'sex', 'age / 50.0::DOUBLE'], kind)} SELECT l.label AS term, round(coef, 6) AS coef, round(se, 6) AS se, round(loglik, 4) AS loglik, round(score, 4) AS score
        FROM ({oracle.fits_sql(['one', 'sex', 'older'], 10)}) q JOIN (VALUES ('one', '(intercept)'), ('sex', 'sex'), ('older', 'older')) l(term, label) USING (term)""")(run)


_regression_query("newton_logistic", "logistic", "event", "event")
_regression_query("newton_poisson", "poisson", "CAST(floor(dose) AS INT)", "CAST(floor(dose) AS INTEGER)")

#: Transitions between states of a day, with one coefficient of sex for all and one of age for each.
TRANSITIONS = tuple(multistate.Transition(a, b, {"sex": "sex", "older": f"older {a} {b}"}) for a, b in (("click", "error"), ("click", "view"), ("error", "click")))
TRANSITIONS_SQL = """sv AS (SELECT id, day AS start, lead(day) OVER w AS stop, state, lead(state) OVER w AS after, CAST(id % 2 AS INTEGER) AS sex, (20 + (id * 7) % 50) / 50.0::DOUBLE AS older
        FROM (SELECT id, day, min(event_type) AS state FROM ev GROUP BY id, day) q WINDOW w AS (PARTITION BY id ORDER BY day)),
    tr(k, a, b) AS (VALUES (1, 'click', 'error'), (2, 'click', 'view'), (3, 'error', 'click')),
    sk AS (SELECT k, start, stop, CAST(after = b AS INTEGER) AS event, sex, older FROM sv JOIN tr ON state = a WHERE stop IS NOT NULL), dt AS (SELECT DISTINCT k, stop AS t FROM sk WHERE event = 1),
    covered AS (SELECT k * 1000 + t AS stop, CASE WHEN event = 1 AND sk.stop = t THEN 1 ELSE 0 END AS event, sex AS c1, CASE WHEN k = 1 THEN older ELSE 0 END AS c2, CASE WHEN k = 2 THEN older ELSE 0 END AS c3, CASE WHEN k = 3 THEN older ELSE 0 END AS c4
        FROM sk JOIN dt USING (k) WHERE start < t AND t <= sk.stop)"""


def _multistate_query(name: str, **options) -> None:
    def run(spark, sf_dir):
        st = panels.events(spark, sf_dir).groupBy("id", "day").agg(F.min("event_type").alias("state"))
        order = Window.partitionBy("id").orderBy("day")
        rows = st.select("id", F.col("day").alias("start"), F.lead("day").over(order).alias("stop"), "state", F.lead("state").over(order).alias("after")).where("stop IS NOT NULL")
        rows = rows.withColumns({"sex": F.col("id") % 2, "older": (20 + (F.col("id") * 7) % 50) / 50})
        return _fit_rows(spark, multistate.multistate_fit(rows, TRANSITIONS, **options))

    run.__name__ = name
    query(f"""WITH {TRANSITIONS_SQL}, {oracle.newton_sql(['c1', 'c2', 'c3', 'c4'], table='covered')}, q AS ({_fit_rows_sql(['c1', 'c2', 'c3', 'c4'])})
        SELECT l.label AS term, q.* EXCLUDE (term) FROM q JOIN (VALUES ('c1', 'sex'), ('c2', 'older click error'), ('c3', 'older click view'), ('c4', 'older error click')) l(term, label) USING (term)""", EVENTS_SQL)(run)


_multistate_query("multistate_shared_coefficient")
_multistate_query("multistate_distributed", driver_rows=0)


LP_SQL = f"{DESIGN_SQL}, {oracle.newton_sql(['c1', 'c2', 'c3'], table='ds')}, b AS (SELECT * FROM it WHERE i = 8)"


@query(f"WITH {LP_SQL} SELECT id, stop, round(b1 * sex + b2 * CAST(id % 3 = 1 AS INTEGER) + b3 * CAST(id % 3 = 2 AS INTEGER), 6) + 0.0 AS lp FROM panel, b")
def design_prediction(spark, sf_dir):
    # the model's columns are made again for the rows that are predicted
    rows = _banded(spark, sf_dir)
    model = cox.cox("Surv(start, stop, event) ~ sex + factor(band)", rows)
    return _rounded(model.linear_predictor(rows.select("id", "stop", "sex", "band")).select("id", "stop", "lp"))


def _likelihood_query(name: str, ties: str) -> None:
    def run(spark, sf_dir):
        rows = riskset.compact(_panel(spark, sf_dir), ["sex", "age"])
        out = riskset.likelihood(riskset.sums(rows, ["sex", "age"], BETA), 2, ties)
        return _rounded(out.withColumnsRenamed({"loss": "f", "g_0": "g1", "g_1": "g2", "h_0_0": "h11", "h_0_1": "h12", "h_1_1": "h22"}), 4)

    run.__name__ = name
    columns = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("f", "g1", "g2", "h11", "h12", "h22"))
    at = f"(SELECT 0 AS i, CAST({BETA[0]} AS DOUBLE) AS b1, CAST({BETA[1]} AS DOUBLE) AS b2) z"
    query(f"WITH {oracle.compact_sql(['sex', 'age'])} SELECT {columns} FROM ({oracle.eval_sql(2, ties, 0.0, at)}) q")(run)


_likelihood_query("negloglik_efron", "efron")
_likelihood_query("negloglik_breslow", "breslow")


@query(f"""WITH {WEEKLY_SQL}, t AS (SELECT stop AS t, count(*) AS deaths FROM weekly WHERE event = 1 GROUP BY stop)
    SELECT t, CAST(deaths AS DOUBLE) AS deaths, round(sum(exp(-0.2 * sex + 0.004 * age)), 6) AS s0, round(sum(age * exp(-0.2 * sex + 0.004 * age)), 4) AS s1_age
    FROM t JOIN weekly w ON w.start < t AND t <= w.stop GROUP BY t, deaths""")
def riskset_interval(spark, sf_dir):
    rows = riskset.compact(_weekly(_panel(spark, sf_dir)), ["sex", "age"], start="start")
    out = riskset.sums(rows, ["sex", "age"], BETA, start="start")
    return out.select("t", "deaths", F.round(F.col("a") + F.col("d"), 6).alias("s0"), F.round(F.col("a_1") + F.col("d_1"), 4).alias("s1_age"))


@query("SELECT stop AS t, CAST(sum(event) AS DOUBLE) AS deaths, round(sum(CASE WHEN event = 0 THEN exp(-0.2 * sex + 0.004 * age) ELSE 0 END), 6) AS a, round(sum(CASE WHEN event = 1 THEN exp(-0.2 * sex + 0.004 * age) ELSE 0 END), 6) AS d FROM panel GROUP BY stop HAVING sum(event) > 0")
def riskset_aligned(spark, sf_dir):
    rows = riskset.compact(_panel(spark, sf_dir), ["sex", "age"])
    return _rounded(riskset.sums(rows, ["sex", "age"], BETA).select("t", "deaths", "a", "d"))


# --- residuals, hazards, concordance

RISK_SQL = f"r AS (SELECT *, exp({BETA[0]} * sex + {BETA[1]} * age) AS risk FROM panel)"
TIMES_SQL = RISK_SQL + """, dt AS (SELECT t, den, eden, deaths FROM (
        SELECT e.stop AS t, sum(e.risk) FILTER (e.event = 1) AS eden, count(*) FILTER (e.event = 1) AS deaths, (SELECT sum(risk) FROM r WHERE r.start < e.stop AND e.stop <= r.stop) AS den
        FROM r e GROUP BY e.stop) q WHERE deaths > 0)"""


def _hazard_sql(ties: str) -> str:
    part = "1.0 / (den - k / deaths * eden)" if ties == "efron" else "1.0 / den"
    own = f"(1 - k / deaths) * {part}" if ties == "efron" else part
    return f"{TIMES_SQL}, hz AS (SELECT t, deaths, sum({part}) AS h, sum({own}) AS e FROM (SELECT dt.*, CAST(k AS DOUBLE) AS k FROM dt, generate_series(0, (SELECT CAST(max(deaths) AS BIGINT) - 1 FROM dt)) ks(k) WHERE k < deaths) q GROUP BY t, deaths)"


def _risky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir).withColumn("risk", F.exp(riskset.predictor(["sex", "age"], BETA)))


@query(f"WITH {_hazard_sql('efron')} SELECT t, deaths, round(h, 8) AS h, round(e, 8) AS e, round(sum(h) OVER (ORDER BY t), 8) AS cumhaz FROM hz")
def baseline_cumhaz(spark, sf_dir):
    return _rounded(riskset.hazards(_risky(spark, sf_dir)), 8)


def _residual_query(name: str, ties: str) -> None:
    def run(spark, sf_dir):
        return _rounded(riskset.martingale(_risky(spark, sf_dir), ties=ties))

    run.__name__ = name
    query(f"""WITH {_hazard_sql(ties)} SELECT id, stop, round(event - risk * coalesce(sum(CASE WHEN event = 1 AND t = stop THEN e ELSE h END), 0), 6) + 0.0 AS resid
        FROM r LEFT JOIN hz ON start < t AND t <= stop GROUP BY id, stop, event, risk""")(run)


_residual_query("martingale_efron", "efron")
_residual_query("martingale_breslow", "breslow")


@query(f"""WITH one AS (SELECT id, max(stop) AS stop, max(event) AS event, exp({BETA[0]} * max(sex) + {BETA[1]} * max(age)) AS risk FROM panel GROUP BY id),
    hz AS (SELECT e.stop AS t, count(*) * 1.0 / (SELECT sum(risk) FROM one WHERE one.stop >= e.stop) AS h FROM one e WHERE event = 1 GROUP BY e.stop)
    SELECT id, stop, round(event - risk * coalesce(sum(h), 0), 6) + 0.0 AS resid FROM one LEFT JOIN hz ON t <= stop GROUP BY id, stop, event, risk""")
def martingale_right_censored(spark, sf_dir):
    one = _risky(spark, sf_dir).groupBy("id").agg(F.max("stop").alias("stop"), F.max("event").alias("event"), F.max("risk").alias("risk"))
    return _rounded(riskset.martingale(one, start=None, ties="breslow"))


@query(f"""WITH {ONCE_SQL}, one AS (SELECT time, status, exp({BETA[0]} * sex) AS risk FROM once),
    hz AS (SELECT e.time AS t, count(*) * 1.0 / (SELECT sum(risk) FROM one WHERE one.time >= e.time) AS h FROM one e WHERE status = 1 GROUP BY e.time)
    SELECT time, status, round(status - risk * coalesce((SELECT sum(h) FROM hz WHERE t <= time), 0), 6) + 0.0 AS resid FROM one""")
def martingale_repeated_rows(spark, sf_dir):
    rows = _once(spark, sf_dir).select("time", "status", F.exp(riskset.predictor(["sex"], BETA[:1])).alias("risk"))
    return _rounded(riskset.martingale(rows, start=None, stop="time", event="status", ties="breslow", keys=["time", "status"]))


@query(f"""WITH {RISK_SQL}, s AS (SELECT start, stop, event, round(risk, 9) AS x, id FROM r),
    p AS (SELECT a.x AS x1, b.x AS x FROM s a JOIN s b ON b.start < a.stop AND a.stop <= b.stop AND NOT (b.event = 1 AND b.stop = a.stop) WHERE a.event = 1),
    c AS (SELECT count(*) FILTER (x1 > x) AS concordant, count(*) FILTER (x1 < x) AS discordant, count(*) FILTER (x1 = x) AS tied_x FROM p),
    y AS (SELECT count(*) FILTER (a.x <> b.x) AS tied_y, count(*) FILTER (a.x = b.x) AS tied_xy FROM s a JOIN s b ON a.stop = b.stop AND a.id < b.id WHERE a.event = 1 AND b.event = 1)
    SELECT concordant, discordant, tied_x, tied_y, tied_xy, round((concordant + tied_x / 2) / (concordant + discordant + tied_x), 6) AS concordance FROM c, y""")
def concordance_counts(spark, sf_dir):
    return _rounded(riskset.concordance(_risky(spark, sf_dir), "risk"))


@query(f"""WITH {RISK_SQL}, s AS (SELECT start, stop, event, round(risk, 9) AS x, id FROM r),
    p AS (SELECT a.id AS i, a.stop AS it, b.id AS j, b.stop AS jt, CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0.0 END::DOUBLE AS won
        FROM s a JOIN s b ON b.start < a.stop AND a.stop <= b.stop AND NOT (b.event = 1 AND b.stop = a.stop) WHERE a.event = 1),
    u AS (SELECT sum(won) AS w, count(*) AS n FROM (SELECT i AS id, it AS t, won FROM p UNION ALL SELECT j, jt, won FROM p) q GROUP BY id, t),
    c AS (SELECT sum(won) / count(*) AS c, count(*) AS pairs FROM p)
    SELECT round(any_value(c), 6) AS concordance, round(sqrt(sum((w - c * n) * (w - c * n))) / any_value(pairs), 6) AS se FROM u, c""")
def concordance_error(spark, sf_dir):
    return _rounded(riskset.concordance_error(_risky(spark, sf_dir), "risk"))


# --- ordered operators


@query("WITH u AS (SELECT id, day, count(*) AS n FROM ev GROUP BY id, day) SELECT id, day - 1 AS start, day AS stop, CAST((lag(day) OVER w IS NULL)::INT + 2 * (lead(day) OVER w IS NULL)::INT AS INTEGER) AS position, CAST(sign(day - 1 - lag(day) OVER w) AS INTEGER) AS gap FROM u WINDOW w AS (PARTITION BY id ORDER BY day)", EVENTS_SQL)
def interval_check(spark, sf_dir):
    days = panels.events(spark, sf_dir).select("id", "day").distinct()
    return panel.interval_check(days.select("id", (F.col("day") - 1).alias("start"), F.col("day").alias("stop")))


@query("""WITH u AS (SELECT id, day, min(event_type) AS before, max(event_type) AS after FROM ev GROUP BY id, day), l AS (SELECT day - 1 - lag(day) OVER w AS gap, before <> lag(after) OVER w AS other FROM u WINDOW w AS (PARTITION BY id ORDER BY day))
    SELECT count(*) FILTER (gap < 0) AS overlaps, count(*) FILTER (gap > 0) AS gaps, count(*) FILTER (gap > 0 AND other) AS jumps, count(*) FILTER (gap = 0 AND other) AS teleports FROM l""", EVENTS_SQL)
def state_check(spark, sf_dir):
    days = panels.events(spark, sf_dir).groupBy("id", "day").agg(F.min("event_type").alias("before"), F.max("event_type").alias("after"))
    return panel.state_check(days.select("id", (F.col("day") - 1).alias("start"), F.col("day").alias("stop"), "before", "after"), "id", "start", "stop", "before", "after")


@query("""WITH u AS (SELECT id, day, min(event_type) AS before, max(event_type) AS after FROM ev GROUP BY id, day), l AS (SELECT id, day, day - 1 - lag(day) OVER w AS gap, before <> lag(after) OVER w AS other FROM u WINDOW w AS (PARTITION BY id ORDER BY day))
    SELECT id, day AS stop, coalesce(gap < 0, FALSE) AS overlap, coalesce(gap > 0, FALSE) AS gap, coalesce(gap > 0 AND other, FALSE) AS jump, coalesce(gap = 0 AND other, FALSE) AS teleport FROM l""", EVENTS_SQL)
def state_flags(spark, sf_dir):
    days = panels.events(spark, sf_dir).groupBy("id", "day").agg(F.min("event_type").alias("before"), F.max("event_type").alias("after"))
    rows = days.select("id", (F.col("day") - 1).alias("start"), F.col("day").alias("stop"), "before", "after")
    return panel.state_flags(rows, "id", "start", "stop", "before", "after").select("id", "stop", "overlap", "gap", "jump", "teleport")


STATES_SQL = "st AS (SELECT id, day, min(event_type) AS state FROM ev GROUP BY id, day)"


@query(f"WITH {STATES_SQL}, l AS (SELECT lag(state) OVER (PARTITION BY id ORDER BY day) AS from_state, state AS to_state FROM st) SELECT from_state, to_state, count(*) AS n FROM l WHERE from_state IS NOT NULL GROUP BY ALL", EVENTS_SQL)
def state_transitions(spark, sf_dir):
    return panel.transitions(panels.events(spark, sf_dir).groupBy("id", "day").agg(F.min("event_type").alias("state")), "id", "day", "state")


@query(f"WITH {NULLS_SQL} SELECT id, stop, event, last_value(age IGNORE NULLS) OVER w AS age, last_value(sex IGNORE NULLS) OVER w AS sex FROM n WINDOW w AS (PARTITION BY id ORDER BY stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def locf(spark, sf_dir):
    return panel.carry_forward(_with_nulls(_panel(spark, sf_dir)), "id", "stop", ["age", "sex"])


@query(f"WITH {STATES_SQL}, l AS (SELECT id, day AS start, lead(day) OVER w AS stop, lead(CAST(state = 'purchase' AS INTEGER)) OVER w AS event, state FROM st WINDOW w AS (PARTITION BY id ORDER BY day)) SELECT * FROM l WHERE stop IS NOT NULL", EVENTS_SQL)
def surv2_to_interval(spark, sf_dir):
    st = panels.events(spark, sf_dir).groupBy("id", "day").agg(F.min("event_type").alias("state"))
    return panel.to_intervals(st.withColumn("hit", (F.col("state") == "purchase").cast("int")), "id", "day", "hit", ["state"])


@query("SELECT id, max(stop) AS stop, max_by(event, stop) AS event FROM panel GROUP BY id")
def last_row_per_id(spark, sf_dir):
    return panel.last_rows(_panel(spark, sf_dir).select("id", "stop", "event"), "id", "stop")


@query(f"WITH {DEATHS_SQL} SELECT t AS stop, n AS deaths, dense_rank() OVER (ORDER BY t) AS grp, CAST(sum(n) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS later FROM deaths")
def run_length_and_suffix_sum(spark, sf_dir):
    deaths = ordered.runs(panel.death_times(_panel(spark, sf_dir)), "stop", "grp")
    return ordered.suffix_sums(deaths, "stop", "deaths", "later")


@query("""WITH d AS (SELECT id, sum(dose) AS dose FROM panel GROUP BY id)
    SELECT id, round(cume_dist() OVER (PARTITION BY id % 4 ORDER BY round(dose, 6)), 6) AS ecdf, rank() OVER (PARTITION BY id % 4 ORDER BY round(dose, 6)) AS rank FROM d""")
def ecdf_and_ranks(spark, sf_dir):
    d = _panel(spark, sf_dir).groupBy("id").agg(F.round(F.sum("dose"), 6).alias("dose")).withColumn("part", F.col("id") % 4)
    return _rounded(ordered.distribution(d, "dose", ["part"]).select("id", "ecdf", "rank"))


@query("SELECT id, stop, CAST(coalesce(lag(dose, 1) OVER w, 0) > 0 AND coalesce(lag(dose, 2) OVER w, 0) > 0 AS INTEGER) AS danger FROM panel WINDOW w AS (PARTITION BY id ORDER BY stop)")
def lagged_danger(spark, sf_dir):
    return _panel(spark, sf_dir).select("id", "stop", ordered.preceded_by("id", "stop", F.col("dose") > 0, 2).cast("int").alias("danger"))


@query("""WITH q AS (SELECT id, stop, rank() OVER (PARTITION BY stop ORDER BY age) + (count(*) OVER (PARTITION BY stop, age) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY stop) AS n FROM panel)
    SELECT id, stop, round((r - 0.5) / (0.5 + n - r), 6) AS obrien FROM q""")
def obrien_transform(spark, sf_dir):
    return _rounded(ordered.logit_ranks(_panel(spark, sf_dir).select("id", "stop", "age"), "stop", "age").select("id", "stop", "obrien"))


@query("SELECT stop, event, count(*) AS n FROM panel GROUP BY stop, event ORDER BY stop, event")
def time_death_sort(spark, sf_dir):
    return _panel(spark, sf_dir).groupBy("stop", "event").agg(F.count("*").alias("n")).orderBy("stop", "event")


@query("SELECT id, stop, 'sex' AS name, sex AS value FROM panel UNION ALL SELECT id, stop, 'age', age FROM panel")
def unpivot_covariates(spark, sf_dir):
    return _panel(spark, sf_dir).unpivot(["id", "stop"], ["sex", "age"], "name", "value")


# --- resampling

@query(f"WITH f AS (SELECT row_number() OVER (ORDER BY id, stop) - 1 AS i, id, stop FROM panel WHERE stop IN (SELECT stop FROM panel WHERE event = 1)), {oracle.drawn_sql('SELECT count(*) FROM f', 3)} SELECT id, stop, b, w FROM f JOIN weights USING (i)")
def bootstrap_weights_row(spark, sf_dir):
    rows = panel.at_death_times(_panel(spark, sf_dir)).select("id", "stop")
    return resample.row_bootstrap(rows, 3).select("id", "stop", "b", "w")


@query(f"WITH f AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, id FROM subj), {oracle.drawn_sql('SELECT count(*) FROM f', 3)} SELECT p.id, stop, b, w FROM panel p JOIN f USING (id) JOIN weights USING (i)")
def bootstrap_weights_subject(spark, sf_dir):
    return resample.subject_bootstrap(_panel(spark, sf_dir).select("id", "stop"), 3).select("id", "stop", "b", "w")


@query(f"WITH f AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, id FROM subj), {oracle.drawn_sql('SELECT count(*) FROM f', 3)} SELECT id, b, copy FROM f JOIN weights USING (i), generate_series(1, 100) c(copy) WHERE copy <= w")
def repeated_subjects(spark, sf_dir):
    ids = _panel(spark, sf_dir).select("id").distinct()
    return resample.repeat_rows(resample.subject_bootstrap(ids, 3)).select("id", "b", F.col("copy").cast("long").alias("copy"))


@query(f"WITH {oracle.permuted_sql('subj', 4)} SELECT p, id, other FROM perm")
def permutation_table(spark, sf_dir):
    return resample.permutations(_panel(spark, sf_dir), 4).select(F.col("p").cast("long").alias("p"), "id", "other")


ROWS_SQL = "f AS (SELECT row_number() OVER (ORDER BY id, stop) - 1 AS i, * FROM panel WHERE stop IN (SELECT stop FROM panel WHERE event = 1))"
SUBJECTS_SQL = "fs AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, id FROM (SELECT DISTINCT id FROM panel WHERE stop IN (SELECT stop FROM panel WHERE event = 1)) q)"


def _replicates_sql(count: int, unit: str = "row", covariates: tuple[str, ...] = ("sex", "age"), rounds: int = 8) -> str:
    """Tables up to fits (b, term, coef, se, loglik, ...) of replicates of the panel."""
    names = ", ".join(covariates)
    if unit == "row":
        drawn = f"{ROWS_SQL}, {oracle.drawn_sql('SELECT count(*) FROM f', count)}, bt AS (SELECT b, stop, event, {names}, w FROM f JOIN weights USING (i))"
    else:
        drawn = f"{SUBJECTS_SQL}, {oracle.drawn_sql('SELECT count(*) FROM fs', count)}, bt AS (SELECT b, stop, event, {names}, w FROM panel JOIN fs USING (id) JOIN weights USING (i))"
    return f"{drawn}, {oracle.newton_sql(list(covariates), table='bt', keys=('b',), weight='w', rounds=rounds)}, fits AS ({oracle.fits_sql(list(covariates), rounds, ('b',))})"


@query(f"WITH {_replicates_sql(40)} SELECT term, round(quantile_cont(coef, 0.025), 6) AS lo, round(quantile_cont(coef, 0.975), 6) AS hi FROM fits GROUP BY term")
def cox_bootstrap_ci(spark, sf_dir):
    return _rounded(cox.cox_bootstrap("Surv(start, stop, event) ~ sex + age", _panel(spark, sf_dir), 40).confint())


@query(f"WITH {_replicates_sql(20, 'subject')} SELECT b, term, round(coef, 6) AS coef, round(se, 6) AS se, round(loglik, 6) AS loglik FROM fits")
def cox_bootstrap_subjects(spark, sf_dir):
    return _rounded(replicates.bootstrap_fits(_panel(spark, sf_dir), ["sex", "age"], 20, batchsize=5, unit="subject"))


@query(f"WITH {_replicates_sql(6)} SELECT b, term, round(coef, 6) AS coef, CASE WHEN b = 0 THEN round(se, 6) END AS se, CASE WHEN b = 0 THEN round(loglik, 6) END AS loglik FROM fits")
def cox_bootstrap_distributed(spark, sf_dir):
    return _rounded(replicates.bootstrap_fits(_panel(spark, sf_dir), ["sex", "age"], 6, all_results=False, task_values=0))


@query(f"""WITH {WEEKLY_SQL}, f AS (SELECT row_number() OVER (ORDER BY id, stop) - 1 AS i, * FROM weekly), {oracle.drawn_sql('SELECT count(*) FROM f', 5)}, dt AS (SELECT DISTINCT stop AS t FROM weekly WHERE event = 1),
    bt AS (SELECT b, t AS stop, CASE WHEN event = 1 AND stop = t THEN 1 ELSE 0 END AS event, sex, age, w FROM f JOIN weights USING (i) JOIN dt ON start < t AND t <= stop),
    {oracle.newton_sql(['sex', 'age'], table='bt', keys=('b',), weight='w')} SELECT b, term, round(coef, 6) AS coef, round(se, 6) AS se, round(loglik, 5) AS loglik FROM ({oracle.fits_sql(['sex', 'age'], 8, ('b',))}) q""")
def cox_bootstrap_intervals(spark, sf_dir):
    rows = cox.cox_bootstrap("Surv(start, stop, event) ~ sex + age", _weekly(_panel(spark, sf_dir)), 5, risk_set="interval", all_results=True).fits.drop(*replicates.STATISTICS)
    return _rounded(rows.withColumn("loglik", F.round("loglik", 5)))


@query(f"""WITH {ONCE_SQL}, f AS (SELECT row_number() OVER (ORDER BY time, status, sex) - 1 AS i, * FROM once), {oracle.drawn_sql('SELECT count(*) FROM f', 4)}, dt AS (SELECT DISTINCT time AS t FROM once WHERE status = 1),
    bt AS (SELECT b, t AS stop, CASE WHEN status = 1 AND time = t THEN 1 ELSE 0 END AS event, sex, w FROM f JOIN weights USING (i) JOIN dt ON t <= time),
    {oracle.newton_sql(['sex'], 'breslow', table='bt', keys=('b',), weight='w')} SELECT b, term, round(coef, 6) AS coef, round(se, 6) AS se, round(loglik, 5) AS loglik FROM ({oracle.fits_sql(['sex'], 8, ('b',))}) q""")
def cox_bootstrap_right_censored(spark, sf_dir):
    # beyond what a task may hold: the replicates share their aggregations
    rows = cox.cox_bootstrap("Surv(time, status) ~ sex", _once(spark, sf_dir), 4, ties="breslow", all_results=True, task_values=0).fits.drop(*replicates.STATISTICS)
    return _rounded(rows.withColumn("loglik", F.round("loglik", 5)))


@query(f"""WITH {_replicates_sql(4)}, co AS (SELECT b, max(coef) FILTER (term = 'sex') AS b1, max(coef) FILTER (term = 'age') AS b2 FROM fits GROUP BY b),
    wa AS (SELECT b, b1 * b1 * h11 + 2 * b1 * b2 * h12 + b2 * b2 * h22 AS wald FROM it WHERE i = 8),
    sc AS (SELECT b, start, stop, event, round(b1 * sex + b2 * age, 9) AS x, count(*) AS n FROM panel, co GROUP BY ALL),
    pr AS (SELECT u.b, sum(u.n * v.n) FILTER (u.x > v.x) AS concordant, sum(u.n * v.n) FILTER (u.x < v.x) AS discordant, sum(u.n * v.n) FILTER (u.x = v.x) AS tied_x
        FROM sc u JOIN sc v ON u.b = v.b AND v.start < u.stop AND u.stop <= v.stop AND NOT (v.event = 1 AND v.stop = u.stop) WHERE u.event = 1 GROUP BY u.b)
    SELECT f.b, round(f.loglik, 5) AS loglik, round(f.loglik_init, 5) AS loglik_init, round(f.score, 5) AS score, round(wald, 5) AS wald, 2 AS df, CAST(concordant AS BIGINT) AS concordant, CAST(discordant AS BIGINT) AS discordant,
        CAST(tied_x AS BIGINT) AS tied_x, round((concordant + tied_x / 2) / (concordant + discordant + tied_x), 5) AS concordance FROM fits f JOIN wa USING (b) JOIN pr USING (b) WHERE term = 'sex'""")
def cox_bootstrap_all_results(spark, sf_dir):
    return _rounded(cox.cox_bootstrap("Surv(start, stop, event) ~ sex + age", _panel(spark, sf_dir), 4, all_results=True).results(), 5)


# --- exposure models


def _lags(df: DataFrame, reach: int) -> DataFrame:
    """(lag, pairs, mass): pairs of a row and a dose before it at each lag, and their doses."""
    source = df.where("dose <> 0").select("id", F.col("stop").alias("__s"), F.col("dose").alias("__dose"))
    pairs = exposure.within_reach(df.select("id", "stop"), source, ["id"], "stop", reach).where("__s IS NOT NULL")
    return pairs.groupBy((F.col("stop") - F.col("__s")).cast("int").alias("lag")).agg(F.count("*").alias("pairs"), F.sum("__dose").alias("mass"))


LAGS_SQL = "lags AS (SELECT CAST(p.stop - s.stop AS INTEGER) AS lag, count(*) AS pairs, sum(s.dose) AS mass FROM panel p JOIN panel s ON s.id = p.id AND s.dose <> 0 AND s.stop <= p.stop GROUP BY 1)"


@query(f"WITH {LAGS_SQL}, {oracle.atoms_sql(CUTOFF, KNOTS)} SELECT lag, k, round(value, 8) + 0.0 AS value, pairs FROM atoms JOIN lags USING (lag)")
def spline_atoms(spark, sf_dir):
    # the basis at the lags that the panel's doses have
    atoms = splines.atoms_table(spark, splines.atoms(CUTOFF, KNOTS))
    return _rounded(atoms.join(_lags(_panel(spark, sf_dir), CUTOFF).select("lag", "pairs"), "lag"), 8)


@query(f"WITH {LAGS_SQL}, {oracle.atoms_sql(90, 1)} SELECT k, round(sum(value), 6) AS area, round(sum(value * coalesce(mass, 0)), 4) + 0.0 AS mass FROM atoms LEFT JOIN lags USING (lag) GROUP BY k")
def spline_areas(spark, sf_dir):
    # of each spline, and of the panel's doses under it
    found = splines.atoms_table(spark, splines.atoms(90, 1)).join(_lags(_panel(spark, sf_dir), 90), "lag", "left").groupBy("k")
    return found.agg(F.round(F.sum("value"), 6).alias("area"), (F.round(F.sum(F.col("value") * F.coalesce("mass", F.lit(0.0))), 4) + 0.0).alias("mass"))


@query("""WITH c AS (SELECT max(stop) AS cutoff FROM panel)
    SELECT CAST(v AS INTEGER) AS i, CAST(v - 3 AS DOUBLE) AS knot FROM generate_series(0, 3) q(v) UNION ALL SELECT 4, CAST(round_even((1 + cutoff) / 2.0, 0) AS DOUBLE) FROM c UNION ALL SELECT CAST(v + 5 AS INTEGER), CAST(cutoff + v AS DOUBLE) FROM c, generate_series(0, 3) q(v)""")
def spline_knots(spark, sf_dir):
    # for a window as long as the panel's longest follow-up
    cutoff = _panel(spark, sf_dir).agg(F.max("stop")).first()[0]
    return spark.createDataFrame(list(enumerate(splines.knots(int(cutoff), 1))), "i int, knot double")


def _wce(spark: SparkSession, sf_dir: str, **options) -> wce.WceModel:
    return wce.wce_fit(_panel(spark, sf_dir), ["sex", "age"], **({"cutoff": CUTOFF, "nknots": KNOTS} | options))


#: Newton steps of the exposure models' SQL.
WCE_ROUNDS = 12


def _wce_sql(count: int, cutoff: int = CUTOFF, nknots: int = KNOTS, kept: tuple[int, ...] | None = None, tail: str = "") -> str:
    """Tables atoms, feat, wp (outcome, covariates, features), it and fits of an exposure model; tail keeps names apart."""
    names = ["sex", "age", *[f"D{k + 1}" for k in range(count)]]
    return f"""{oracle.atoms_sql(cutoff, nknots, kept)}, {oracle.features_sql(count, cutoff)}, wp AS MATERIALIZED (SELECT p.id, p.stop, p.event, p.sex, p.age, feat.* EXCLUDE (id, stop) FROM panel p JOIN feat USING (id, stop)),
        {oracle.newton_sql(names, table='wp', rounds=WCE_ROUNDS)}, fits AS MATERIALIZED ({oracle.fits_sql(names, WCE_ROUNDS)})"""


def _wce_rows(name: str, count: int, kept: tuple[int, ...] | None = None, **options) -> None:
    def run(spark, sf_dir):
        m = _wce(spark, sf_dir, **options)
        rows = [(t, float(b), float(s), m.cox.loglik, m.information("bic"), m.information("aic")) for t, b, s in zip(m.cox.covariates, m.cox.coef, m.cox.se)]
        return _rounded(spark.createDataFrame(rows, "term string, coef double, se double, loglik double, bic double, aic double"), 5)

    run.__name__ = name
    p = count + 2
    query(f"""WITH {_wce_sql(count, options.get('cutoff', CUTOFF), options.get('nknots', KNOTS), kept)}
        SELECT term, round(coef, 5) AS coef, round(se, 5) AS se, round(loglik, 5) AS loglik, round({p} * ln((SELECT sum(event) FROM panel)) - 2 * loglik, 5) AS bic, round({2 * p} - 2 * loglik, 5) AS aic FROM fits""")(run)


_wce_rows("wce_fit", 5)
_wce_rows("wce_fit_right", 3, RIGHT, constrained="Right")
_wce_rows("wce_fit_left", 3, LEFT, constrained="Left")
_wce_rows("wce_fit_2_knots", 6, cutoff=10, nknots=2)

#: Of the unconstrained model: covariance of spline coefficients (i, j, v), from the inverse information.
VCOV_SQL = "inv AS MATERIALIZED (SELECT * FROM " + oracle.solved_sql("(SELECT *, " + ", ".join(f"CAST({int(i == j)} AS DOUBLE) AS u{j}_{i}" for j in range(1, 8) for i in range(1, 8)) + f" FROM it WHERE i = {WCE_ROUNDS})", 7, [f"u{j}_" for j in range(1, 8)], [f"b{j}" for j in range(1, 8)]) + " s), vc AS (" + " UNION ALL ".join(f"SELECT {j - 2} AS i, {i - 2} AS j, u{j}_{i} AS v FROM inv" for j in range(3, 8) for i in range(3, 8)) + ")"
COEF_SQL = "co AS (SELECT CAST(substr(term, 2) AS INTEGER) AS k, coef FROM fits WHERE term LIKE 'D%')"
Z95 = 1.959963984540054


@query(f"""WITH {_wce_sql(5)}, {VCOV_SQL}, {COEF_SQL}, w AS (SELECT lag, sum(value * coef) AS weight FROM atoms JOIN co USING (k) GROUP BY lag),
    sd AS (SELECT a.lag, sqrt(sum(a.value * v * b.value)) AS sd FROM atoms a JOIN vc ON vc.i = a.k JOIN atoms b ON b.k = vc.j AND b.lag = a.lag GROUP BY a.lag)
    SELECT lag, round(weight, 5) AS weight, round(weight - {Z95} * sd, 5) AS lo, round(weight + {Z95} * sd, 5) AS hi FROM w JOIN sd USING (lag)""")
def wce_curve(spark, sf_dir):
    return _rounded(_wce(spark, sf_dir).curve_table(spark), 5)


TOTAL_SQL = "areas AS (SELECT k, sum(value) AS a FROM atoms GROUP BY k), tr AS (SELECT sum(a * coef) AS risk FROM areas JOIN co USING (k)), ts AS (SELECT sqrt(sum(x.a * v * y.a)) AS sd FROM areas x JOIN vc ON vc.i = x.k JOIN areas y ON y.k = vc.j)"


@query(f"""WITH {_wce_sql(5)}, {VCOV_SQL}, {COEF_SQL}, {TOTAL_SQL}
    SELECT round(exp(risk), 5) AS hr, round(exp(risk - {Z95} * sd), 5) AS lo, round(exp(risk + {Z95} * sd), 5) AS hi, round(exp(risk) - {Z95} * sd, 5) AS plain_lo, round(exp(risk) + {Z95} * sd, 5) AS plain_hi FROM tr, ts""")
def wce_hazard_ratio(spark, sf_dir):
    hr = _wce(spark, sf_dir).hazard_ratio([1.0] * CUTOFF, [0.0] * CUTOFF)
    return _rounded(spark.createDataFrame([tuple(hr.values())], ", ".join(f"{k} double" for k in hr)), 5)


@query(f"""WITH {_wce_sql(5)}, {VCOV_SQL}, {COEF_SQL}, {TOTAL_SQL} SELECT round(risk, 5) AS risk, round(sd, 5) AS sd, round(risk - {Z95} * sd, 5) AS lo, round(risk + {Z95} * sd, 5) AS hi FROM tr, ts""")
def wce_total_risk(spark, sf_dir):
    t = _wce(spark, sf_dir).total_risk()
    return _rounded(spark.createDataFrame([(t["risk"], t["sd"], t["risk"] - Z95 * t["sd"], t["risk"] + Z95 * t["sd"])], "risk double, sd double, lo double, hi double"), 5)


@query(f"""WITH {_wce_sql(5)}, {VCOV_SQL}, {COEF_SQL}, {TOTAL_SQL}, va AS (SELECT vc.i AS k, sum(v * a) AS va FROM vc JOIN areas ON areas.k = vc.j GROUP BY vc.i)
    SELECT k, round({Z95} * va / sd, 5) AS band FROM va, ts""")
def wce_risk_band(spark, sf_dir):
    band = _wce(spark, sf_dir).risk_band()
    return _rounded(spark.createDataFrame([(k + 1, float(b)) for k, b in enumerate(band)], "k int, band double"), 5)


def _bic_sql(count: int, nknots: int) -> str:
    """A query of nknots and bic of an exposure model of its own."""
    return f"(WITH RECURSIVE {_wce_sql(count, CUTOFF, nknots)} SELECT {nknots} AS nknots, {count + 2} * ln((SELECT sum(event) FROM panel)) - 2 * loglik AS bic FROM fits WHERE term = 'sex')"


@query(f"WITH both_ AS ({_bic_sql(5, 1)} UNION ALL {_bic_sql(6, 2)}) SELECT nknots, round(bic, 4) AS bic, bic = (SELECT min(bic) FROM both_) AS chosen FROM both_")
def wce_knot_selection(spark, sf_dir):
    best, values = wce.select_knots(_panel(spark, sf_dir), ["sex", "age"], CUTOFF, (1, 2))
    return _rounded(spark.createDataFrame([(k, v, k == best.nknots) for k, v in values.items()], "nknots int, bic double, chosen boolean"), 4)


def _bootstrapped(spark: SparkSession, sf_dir: str) -> wce.WceBootstrap:
    """Replicates of the right-constrained exposure model."""
    return wce.wce_bootstrap(_panel(spark, sf_dir), ["sex", "age"], CUTOFF, 20, nknots=KNOTS, constrained="Right")


BOOTSTRAPPED_SQL = f"""{oracle.atoms_sql(CUTOFF, KNOTS, RIGHT)}, {oracle.features_sql(3, CUTOFF)}, wp AS MATERIALIZED (SELECT p.id, p.stop, p.event, p.sex, p.age, D1, D2, D3 FROM panel p JOIN feat USING (id, stop)),
    {_replicates_sql(20, covariates=("sex", "age", "D1", "D2", "D3"), rounds=WCE_ROUNDS).replace("FROM panel WHERE stop IN (SELECT stop FROM panel", "FROM wp WHERE stop IN (SELECT stop FROM wp")}, {COEF_SQL.replace("coef FROM", "coef, b FROM")}"""


@query(f"""WITH {BOOTSTRAPPED_SQL}, hr AS (SELECT b, exp(sum(value * coef)) AS hr FROM atoms JOIN co USING (k) GROUP BY b)
    SELECT 'exposed against reference' AS contrast, round(quantile_cont(hr, 0.025), 5) AS lo, round(quantile_cont(hr, 0.975), 5) AS hi FROM hr""")
def hr_bootstrap_ci(spark, sf_dir):
    return _rounded(_bootstrapped(spark, sf_dir).hazard_ratio([1.0] * CUTOFF, [0.0] * CUTOFF), 5)


@query(f"""WITH {BOOTSTRAPPED_SQL}, w AS (SELECT b, lag, sum(value * coef) AS weight FROM atoms JOIN co USING (k) GROUP BY b, lag)
    SELECT lag, round(quantile_cont(weight, 0.025), 5) AS lo, round(quantile_cont(weight, 0.975), 5) AS hi FROM w GROUP BY lag""")
def wce_bootstrap_curve(spark, sf_dir):
    return _rounded(_bootstrapped(spark, sf_dir).curve(), 5)


PAIR_SQL = PAIR_FITS_SQL


@query(f"""WITH {PAIR_SQL}, z AS (SELECT term, coef, se, coef / se AS z FROM fits), p AS ({oracle.normal_two_sided_sql('z', 'z', 'term, coef, se, z')})
    SELECT term, round(coef, 5) AS coef, round(exp(coef), 5) AS exp_coef, round(exp(-coef), 5) AS exp_minus_coef, round(se, 5) AS se, round(z, 5) AS z, round(p, 5) AS p,
    round(coef - {Z95} * se, 5) AS coef_lo, round(coef + {Z95} * se, 5) AS coef_hi, round(exp(coef - {Z95} * se), 5) AS lo, round(exp(coef + {Z95} * se), 5) AS hi FROM p""")
def cox_summary(spark, sf_dir):
    return _rounded(cox.cox_fit(_panel(spark, sf_dir), ["sex", "age"]).summary(spark), 5)


@query(f"WITH {PAIR_SQL} SELECT term, round(coef - 1.6448536269514722 * se, 5) AS lo, round(coef + 1.6448536269514722 * se, 5) AS hi FROM fits")
def cox_confint(spark, sf_dir):
    return _rounded(cox.cox_fit(_panel(spark, sf_dir), ["sex", "age"]).confint(spark, ["age", 1], 0.9), 5)


@query(f"""WITH {PAIR_SQL}, n AS (SELECT count(*) AS n FROM panel), t AS (SELECT 2 * (loglik - loglik_init) AS lr, score, loglik_init, n FROM fits, n WHERE term = 'sex'),
    w AS (SELECT b1 * b1 * h11 + 2 * b1 * b2 * h12 + b2 * b2 * h22 AS wald FROM it WHERE i = 8), a AS (SELECT * FROM t, w)
    SELECT name, round(value, 5) AS value FROM (SELECT 'df' AS name, 2.0::DOUBLE AS value UNION ALL SELECT 'lr', lr FROM a UNION ALL SELECT 'lr_p', exp(-lr / 2) FROM a UNION ALL SELECT 'wald', wald FROM a UNION ALL SELECT 'wald_p', exp(-wald / 2) FROM a
    UNION ALL SELECT 'score', score FROM a UNION ALL SELECT 'score_p', exp(-score / 2) FROM a UNION ALL SELECT 'rsq', 1 - exp(-lr / n) FROM a UNION ALL SELECT 'max_rsq', 1 - exp(2 * loglik_init / n) FROM a) q""")
def cox_tests(spark, sf_dir):
    t = cox.cox_fit(_panel(spark, sf_dir), ["sex", "age"]).tests()
    return _rounded(spark.createDataFrame([(k, float(v)) for k, v in t.items()], "name string, value double"), 5)


SCALED_SQL = "sc AS (SELECT (SELECT sum(abs(sex - (SELECT avg(sex) FROM panel))) FROM panel) AS s1, (SELECT sum(abs(age - (SELECT avg(age) FROM panel))) FROM panel) AS s2), sp AS (SELECT stop, event, sex / s1 AS sex, age / s2 AS age FROM panel, sc)"


@query(f"""WITH {SCALED_SQL}, {oracle.newton_sql(['sex', 'age'], alpha=1e-9, table='sp')}, fits AS MATERIALIZED ({oracle.fits_sql(['sex', 'age'])})
    SELECT term, round(coef / s, 6) AS coef, round(se / s, 6) AS se, round(loglik, 5) AS loglik FROM (SELECT *, CASE WHEN term = 'sex' THEN s1 ELSE s2 END AS s FROM fits, sc) q""")
def cox_doscale_ridge(spark, sf_dir):
    m = cox.cox_fit(_panel(spark, sf_dir), ["sex", "age"], doscale=True, alpha=1e-9)
    rows = [(t, round(float(b), 6), round(float(s), 6), round(m.loglik, 5)) for t, b, s in zip(m.covariates, m.coef, m.se)]
    return spark.createDataFrame(rows, "term string, coef double, se double, loglik double")


# --- channels


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, id, stop, event, dose): the panel's days once for each exposure."""
    ev = panels.events(spark, sf_dir)
    days = panel.expand(panels.subjects(ev), "id", "follow_up", "status").select("id", "stop", "event")
    dosed = panels.doses(ev, None).withColumnsRenamed({"event_type": "channel", "day": "stop"})
    rows = days.select("*", F.explode(F.array(*map(F.lit, CHANNELS))).alias("channel"))
    return rows.join(dosed, ["channel", "id", "stop"], "left").fillna(0.0, ["dose"])


CHANNELS_SQL = """ch AS (SELECT c.channel, p.id, p.stop, p.event, coalesce(x.dose, 0.0) AS dose
    FROM panel p CROSS JOIN (VALUES ('click'), ('view'), ('error'), ('signup')) c(channel)
    LEFT JOIN (SELECT event_type, id, day, sum(value) / 100 AS dose FROM ev GROUP BY ALL) x ON x.event_type = c.channel AND x.id = p.id AND x.day = p.stop)"""


@query(f"WITH {CHANNELS_SQL} SELECT channel, count(*) AS n, round(sum(dose), 4) AS dose, CAST(sum(event) AS BIGINT) AS events FROM ch GROUP BY channel")
def exposure_channels(spark, sf_dir):
    return _rounded(_channels(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.sum("dose").alias("dose"), F.sum("event").alias("events")), 4)


def _channel_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    values = splines.atoms(CUTOFF, KNOTS, constrained="Right")
    ch = _channels(spark, sf_dir)
    found = exposure.features(ch, values, by=["channel"])
    # fits read them again and again
    return written(ch.select("channel", "id", "stop", "event").join(found, ["channel", "id", "stop"])), values


CHANNEL_FEATURES_SQL = f"{CHANNELS_SQL}, {oracle.atoms_sql(CUTOFF, KNOTS, RIGHT)}, {oracle.features_sql(3, CUTOFF, 'ch', ('channel',))}, cf AS MATERIALIZED (SELECT c.channel, c.id, c.stop, c.event, D1, D2, D3 FROM ch c JOIN feat USING (channel, id, stop))"
SPLINES = ["D1", "D2", "D3"]


@query(f"WITH {CHANNEL_FEATURES_SQL}, {oracle.newton_sql(SPLINES, table='cf', keys=('channel',), rounds=WCE_ROUNDS)} SELECT channel, term, round(coef, 5) AS coef, round(se, 5) AS se, round(loglik, 5) AS loglik FROM ({oracle.fits_sql(SPLINES, WCE_ROUNDS, ('channel',))}) q")
def mass_univariate_cox(spark, sf_dir):
    rows, values = _channel_features(spark, sf_dir)
    return _rounded(replicates.channel_fits(rows, "channel", SPLINES), 5)


@query(f"WITH {CHANNEL_FEATURES_SQL}, {oracle.newton_sql(SPLINES, table='cf', keys=('channel',), rounds=WCE_ROUNDS)} SELECT channel, term, round(coef, 5) AS coef, round(se, 5) AS se, round(loglik, 5) AS loglik FROM ({oracle.fits_sql(SPLINES, WCE_ROUNDS, ('channel',))}) q")
def channel_large_covariates(spark, sf_dir):
    # features far from zero, fitted by shared aggregations
    rows = _channel_features(spark, sf_dir)[0].withColumns({c: F.col(c) + 50_000 for c in SPLINES})
    return _rounded(replicates.channel_fits(rows, "channel", SPLINES, task_values=0), 5)


@query(f"""WITH {CHANNEL_FEATURES_SQL}, fs AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, id FROM subj), {oracle.drawn_sql('SELECT count(*) FROM fs', 3)}, cb AS (SELECT channel, b, stop, event, D1, D2, D3, w FROM cf JOIN fs USING (id) JOIN weights USING (i)),
    {oracle.newton_sql(SPLINES, table='cb', keys=('channel', 'b'), weight='w', rounds=WCE_ROUNDS)} SELECT channel, b, term, round(coef, 5) AS coef, round(se, 5) AS se, round(loglik, 5) AS loglik FROM ({oracle.fits_sql(SPLINES, WCE_ROUNDS, ('channel', 'b'))}) q""")
def channel_bootstrap(spark, sf_dir):
    return _rounded(replicates.channel_bootstrap(_channel_features(spark, sf_dir)[0], "channel", SPLINES, 3), 5)


def _risks(spark: SparkSession, sf_dir: str, count: int) -> DataFrame:
    rows, values = _channel_features(spark, sf_dir)
    fits = replicates.permuted_fits(rows, "channel", SPLINES, count) if count else replicates.channel_fits(rows, "channel", SPLINES).withColumn("p", F.lit(0))
    risks = replicates.total_risk(fits, dict(zip(SPLINES, map(float, values.sum(0)))), ["channel", "p"])
    return risks.select("channel", "p", F.round("risk", 6).alias("risk"))


def _risks_sql(count: int) -> str:
    """Tables up to risks (channel, p, risk)."""
    return f"""{CHANNEL_FEATURES_SQL}, {oracle.permuted_sql('subj', count)},
        mv AS MATERIALIZED (SELECT c.channel, p.p, c.stop, c.event, coalesce(o.D1, 0.0) AS D1, coalesce(o.D2, 0.0) AS D2, coalesce(o.D3, 0.0) AS D3 FROM cf c JOIN perm p ON p.id = c.id LEFT JOIN cf o ON o.channel = c.channel AND o.id = p.other AND o.stop = c.stop),
        {oracle.newton_sql(SPLINES, table='mv', keys=('channel', 'p'), rounds=WCE_ROUNDS)}, fits AS MATERIALIZED ({oracle.fits_sql(SPLINES, WCE_ROUNDS, ('channel', 'p'))}),
        risks AS MATERIALIZED (SELECT channel, p, round(sum(coef * a), 6) AS risk FROM fits JOIN (SELECT 'D' || k AS term, sum(value) AS a FROM atoms GROUP BY k) ar USING (term) GROUP BY channel, p)"""


@query(f"WITH {_risks_sql(0)} SELECT channel, round(risk, 5) AS risk FROM risks")
def total_risk_by_channel(spark, sf_dir):
    return _rounded(_risks(spark, sf_dir, 0).select("channel", "risk"), 5)


@query(f"""WITH {_risks_sql(19)}, rk AS (SELECT *, rank() OVER (PARTITION BY channel ORDER BY abs(risk)) AS rank FROM risks), tp AS (SELECT p, max(rank) AS top FROM rk GROUP BY p)
    SELECT r.channel, round(r.risk, 5) AS risk, r.rank, round((SELECT avg(CASE WHEN o.rank >= r.rank THEN 1.0 ELSE 0.0 END) FROM rk o WHERE o.channel = r.channel), 5) AS p_value, round((SELECT avg(CASE WHEN top >= r.rank THEN 1.0 ELSE 0.0 END) FROM tp), 5) AS adjusted_p FROM rk r WHERE p = 0""")
def permutation_test(spark, sf_dir):
    return _rounded(replicates.permutation_test(_risks(spark, sf_dir, 19), "channel").withColumn("rank", F.col("rank").cast("long")), 5)


# --- cohorts: exposures that the table has, outcomes and covariates drawn for its subjects


COHORT_SQL = f"""kinds(drug, kind) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(CHANNELS))}),
    dd AS (SELECT k.drug, p.id AS patient, p.stop AS t, CAST(EXISTS (SELECT 1 FROM ev WHERE ev.id = p.id AND ev.day = p.stop AND ev.event_type = k.kind) AS INTEGER) AS dose FROM panel p, kinds k),
    hh AS (SELECT patient, t, CAST(coalesce(lag(dose, 1) OVER w, 0) = 1 AND coalesce(lag(dose, 2) OVER w, 0) = 1 AND {oracle.hash_sql('patient * 30 + t', '4')} % 10 < 8 AS INTEGER) AS hit FROM dd WHERE drug = 0 WINDOW w AS (PARTITION BY patient ORDER BY t)),
    ee AS (SELECT patient, t, hit + 2 * coalesce(sum(hit) OVER (PARTITION BY patient ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS event FROM hh)"""


def _drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.observed_doses(panels.events(spark, sf_dir), CHANNELS)


@query(f"WITH {COHORT_SQL} SELECT patient, t, CAST(event AS INTEGER) AS event FROM ee")
def drug_cohort(spark, sf_dir):
    return panels.dose_outcomes(_drugs(spark, sf_dir).where("drug = 0"), panels.DAYS, len(CHANNELS))


@query(f"WITH {COHORT_SQL} SELECT patient, t, dose FROM dd WHERE drug = 2")
def drug_of_interest(spark, sf_dir):
    return panels.interest(_drugs(spark, sf_dir), 2)


def _normal_sql(b: str) -> str:
    return f"sqrt(-2 * ln(({oracle.hash_sql('id', b)} + 1) / 2147483648.0::DOUBLE)) * cos(2 * pi() * (({oracle.hash_sql('id', f'({b} + 1)')} + 1) / 2147483648.0::DOUBLE))"


@query("SELECT id, CAST(1 + " + oracle.hash_sql("id", "0") + " % 50 AS INTEGER) AS time, CAST(" + oracle.hash_sql("id", "1") + " % 10000 < 1000 AS INTEGER) AS death, " + ", ".join(f"round({_normal_sql(str(2 + 2 * i))}, 6) + 0.0 AS x{i + 1}" for i in range(5)) + " FROM subj")
def random_benchmark_frame(spark, sf_dir):
    return _rounded(panels.random_frame(panels.subjects(panels.events(spark, sf_dir)), 50, 5))


@query(f"""WITH sp AS (SELECT id, k, 7 * (1 + CAST(floor(exp(0.5 + 0.8 * {_normal_sql('(3 * k)')})) AS BIGINT)) AS n, 0.5 * (1 + {oracle.hash_sql('id', '(3 * k + 2)')} % 6) AS dose FROM subj, generate_series(0, 52) ks(k)),
    bs AS (SELECT *, 1 + coalesce(sum(n) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM sp)
    SELECT id, CAST(unnest(generate_series(CAST(begun AS BIGINT), CAST(least(365, begun + n - 1) AS BIGINT))) AS BIGINT) AS day, dose::DOUBLE AS dose FROM bs WHERE begun <= 365 AND k % 2 = 0""")
def dose_history(spark, sf_dir):
    return panels.dose_histories(panels.subjects(panels.events(spark, sf_dir)).select("id"), 365)
