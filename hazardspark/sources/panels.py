"""Tables of subjects' histories: the person-day panel of an event stream, readers, sinks and simulators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Days of the event stream, the first one, and what ends a history.
DAYS, FIRST_DAY, LEAST_PURCHASE = 30, "2024-01-01", 150


def read_panel(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A parquet panel, only the named columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_results(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, day from 1, event_type, value."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(F.col("user_id").alias("id"), (F.datediff(F.to_date("ts"), F.lit(FIRST_DAY)) + 1).alias("day"), "event_type", "value")


def subjects(ev: DataFrame) -> DataFrame:
    """id, follow_up (first day with a large purchase, or the last day) and status."""
    end = (F.col("event_type") == "purchase") & (F.col("value") >= LEAST_PURCHASE)
    return ev.groupBy("id").agg(
        F.coalesce(F.min(F.when(end, F.col("day"))), F.lit(DAYS)).alias("follow_up"),
        F.max(F.when(end, 1).otherwise(0)).alias("status"),
    )


def doses(ev: DataFrame, kind: str | None = "click") -> DataFrame:
    """id, [event_type,] day, dose: values in hundreds, summed by day."""
    rows = ev.where(F.col("event_type") == kind) if kind else ev
    keys = ["id", "day"] if kind else ["event_type", "id", "day"]
    return rows.groupBy(*keys).agg((F.sum("value") / 100).alias("dose"))


def person_days(spark: SparkSession, sf_dir: str, kind: str = "click") -> DataFrame:
    """The panel (id, start, stop, event, dose, sex, age), one row per subject and day."""
    from hazardspark.operators.panel import expand

    ev = events(spark, sf_dir)
    panel = expand(subjects(ev), "id", "follow_up", "status")
    panel = panel.join(doses(ev, kind).withColumnRenamed("day", "stop"), ["id", "stop"], "left")
    return panel.select(
        "id", "start", "stop", "event", F.coalesce("dose", F.lit(0.0)).alias("dose"),
        (F.col("id") % 2).cast("int").alias("sex"), (20 + (F.col("id") * 7) % 50).cast("int").alias("age"),
    )


def drug_cohort(spark: SparkSession, drugs: int, patients: int, times: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Doses (drug, patient, t, dose), fair coin tosses by the portable hash, and the events that they bring (dose_outcomes of drug 0)."""
    from hazardspark.operators.resample import portable_hash

    cells = spark.range(drugs * patients * times)
    cell = F.col("id") % (patients * times)
    dose = cells.select(
        F.floor(F.col("id") / (patients * times)).cast("int").alias("drug"), F.floor(cell / times).cast("int").alias("patient"), (cell % times).cast("int").alias("t"),
        (portable_hash(cell, F.floor(F.col("id") / (patients * times)).cast("long"), seed) % 2).cast("int").alias("dose"),
    )
    return dose, dose_outcomes(dose.where("drug = 0"), times, drugs, seed)


def observed_doses(ev: DataFrame, drugs: Sequence[str]) -> DataFrame:
    """(drug, patient, t, dose): 1 on days with an event of the kind that a drug stands for (drugs are numbered from 0), for every day of the follow-up."""
    from hazardspark.operators.panel import expand

    days = expand(subjects(ev), "id", "follow_up", "status").select(F.col("id").alias("patient"), F.col("stop").alias("t"))
    kinds = F.array(*[F.struct(F.lit(i).alias("drug"), F.lit(k).alias("kind")) for i, k in enumerate(drugs)])
    taken = ev.select(F.col("id").alias("patient"), F.col("day").alias("t"), F.col("event_type").alias("kind"), F.lit(1).alias("dose")).distinct()
    cells = days.select("*", F.inline(kinds)).join(taken, ["patient", "t", "kind"], "left")
    return cells.select("drug", "patient", "t", F.coalesce("dose", F.lit(0)).alias("dose"))


def dose_outcomes(doses: DataFrame, times: int, salt: int, seed: int = 1) -> DataFrame:
    """(patient, t, event): doses on both days before bring the event with probability 0.8, by the portable hash; 1 at an event, 2 more for each event before.

    Every task, retry and engine draws the same.
    """
    from hazardspark.operators.resample import portable_hash

    by = Window.partitionBy("patient").orderBy("t")
    risk = (F.lag("dose", 1, 0).over(by) == 1) & (F.lag("dose", 2, 0).over(by) == 1)
    lucky = portable_hash((F.col("patient") * times + F.col("t")).cast("long"), F.lit(salt).cast("long"), seed) % 10 >= 8
    event = doses.withColumn("hit", (risk & ~lucky).cast("int"))
    event = event.withColumn("before", F.coalesce(F.sum("hit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return event.select("patient", "t", (F.col("hit") + 2 * F.col("before")).cast("int").alias("event"))


def interest(doses: DataFrame, drug: int) -> DataFrame:
    """The histories of one drug."""
    return doses.where(F.col("drug") == drug).drop("drug")


def _normal(id: str, b: Column, seed: int) -> Column:
    """A standard normal value for each id, from the draws b and b + 1 of the portable hash."""
    from hazardspark.operators.resample import P, portable_hash

    u, v = ((portable_hash(F.col(id).cast("long"), k.cast("long"), seed) + 1) / F.lit(float(P + 1)) for k in (b, b + 1))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def random_frame(ids: DataFrame, times: int, features: int, deaths: float = 0.1, seed: int = 1, id: str = "id") -> DataFrame:
    """(id, time, death, x1, x2, ...) for each id given: uniform times from 1, deaths with the given share, standard normal covariates, by the portable hash."""
    from hazardspark.operators.resample import portable_hash

    def draw(b: int):
        return portable_hash(F.col(id).cast("long"), F.lit(b).cast("long"), seed)

    xs = [_normal(id, F.lit(2 + 2 * i), seed).alias(f"x{i + 1}") for i in range(features)]
    return ids.select(id, (1 + draw(0) % times).cast("int").alias("time"), (draw(1) % 10_000 < int(10_000 * deaths)).cast("int").alias("death"), *xs)


def dose_histories(ids: DataFrame, days: int, seed: int = 1, id: str = "id") -> DataFrame:
    """(id, day, dose) for each id given: alternating spells with and without a dose, of log-normal numbers of weeks, by the portable hash."""
    from hazardspark.operators.resample import portable_hash

    spells = ids.select(id, F.explode(F.sequence(F.lit(0), F.lit(days // 7))).alias("k"))
    weeks = 1 + F.floor(F.exp(0.5 + 0.8 * _normal(id, 3 * F.col("k"), seed)))
    spells = spells.select(id, "k", (7 * weeks).alias("n"), (0.5 * (1 + portable_hash(F.col(id).cast("long"), (3 * F.col("k") + 2).cast("long"), seed) % 6)).alias("dose"))
    # a spell a week at most
    begin = 1 + F.coalesce(F.sum("n").over(Window.partitionBy(id).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spells = spells.withColumn("begin", begin).where(f"begin <= {days} AND k % 2 = 0")
    return spells.select(id, F.explode(F.sequence(F.col("begin"), F.least(F.lit(days), F.col("begin") + F.col("n") - 1))).alias("day"), "dose")


def permutational_events(histories: DataFrame, times: pd.DataFrame, log_hazard: float, seed: int = 1) -> DataFrame:
    """Match sorted (time, status) rows to exposure histories by weighted draws among those still at risk.

    histories: (scenario, id, day, x). A scenario is one sequential experiment and so one task; times has a row per id.
    """
    order = times.sort_values("time", kind="stable")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="id", columns="day", values="x", fill_value=0.0)
        rng, left, out = np.random.default_rng([seed, int(pdf["scenario"].iloc[0])]), list(wide.index), []
        for time, status in zip(order["time"], order["status"]):
            if not left:
                break
            weight = np.exp(log_hazard * wide.loc[left, time].to_numpy()) if status and time in wide.columns else np.ones(len(left))
            pick = int(rng.choice(len(left), p=weight / weight.sum()))
            out.append((int(pdf["scenario"].iloc[0]), int(left.pop(pick)), int(time), int(status)))
        return pd.DataFrame(out, columns=["scenario", "id", "follow_up", "status"])

    return histories.groupBy("scenario").applyInPandas(draw, "scenario long, id long, follow_up int, status int")


#: Weight functions of lags in days, as Spark SQL over the column lag (fixed values).
TRUE_WEIGHTS = {
    "exponential": "7 * exp(-7 * lag / 365)",
    "bilinear": "CASE WHEN lag <= 50 THEN 1 - lag / 50.0D ELSE 0 END",
    "early_peak": "exp(-0.5 * power(((lag + 1) / 365.0D - 0.04) / 0.05, 2)) / (0.05 * sqrt(2 * pi())) / 365",
    "inverted_u": "exp(-0.5 * power(((lag + 1) / 365.0D - 0.2) / 0.06, 2)) / (0.06 * sqrt(2 * pi())) / 365",
    "constant": "CASE WHEN lag BETWEEN 0 AND 180 THEN 1 / 180.0D ELSE 0 END",
}


#: Lags in days from which a weight function is zero, or less than 1e-16 of its largest value.
SUPPORT = {"exponential": 2000.0, "bilinear": 50.0, "early_peak": 190.0, "inverted_u": 270.0, "constant": 180.5}


def true_exposure(panel: DataFrame, shape: str, unit: float = 1.0) -> DataFrame:
    """(id, stop, wce): the doses up to each row, weighed by a known function of the lag times unit, as far back as the function has a weight."""
    from hazardspark.operators.exposure import within_reach

    source = panel.where("dose <> 0").groupBy("id", F.col("stop").alias("__s")).agg(F.sum("dose").alias("__dose"))
    pairs = within_reach(panel.select("id", "stop"), source, ["id"], "stop", SUPPORT[shape] / unit)
    weight = F.expr(TRUE_WEIGHTS[shape].replace("lag", f"(CAST(stop - __s AS DOUBLE) * {float(unit)}D)"))
    return pairs.groupBy("id", "__bucket", "stop").agg(F.coalesce(F.sum(weight * F.col("__dose")), F.lit(0.0)).alias("wce")).drop("__bucket")
