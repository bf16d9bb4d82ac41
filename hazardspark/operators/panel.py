"""Operators on counting-process panels (id, start, stop, event, ...), one row per interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.operators import ordered


def expand(df: DataFrame, id: str, follow_up: str, status: str) -> DataFrame:
    """Unit intervals up to follow_up; the event, if any, on the last."""
    days = df.select("*", F.explode(F.sequence(F.lit(1), F.col(follow_up))).alias("stop"))
    event = ((F.col("stop") == F.col(follow_up)) & (F.col(status) == 1)).cast("int")
    rest = [c for c in df.columns if c not in (id, follow_up, status)]
    return days.select(id, (F.col("stop") - 1).alias("start"), "stop", event.alias("event"), *rest)


def drop_missing(df: DataFrame, used: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(used))


def validate(df: DataFrame, stop: str, event: str, covariates: Sequence[str], start: str | None = None, weight: str | None = None, whole: bool = False) -> int:
    """The number of events, from one aggregate over the used columns; a clear error for what can't be fitted. whole: weights must be whole numbers."""
    checks = [F.count("*").alias("n"), F.max(F.when(~F.col(event).isin(0, 1), 1)).alias("codes"), F.sum(F.col(event).cast("long")).alias("deaths")]
    checks += [F.max(F.when(F.abs(F.col(c).cast("double")).isin(float("inf")) | F.isnan(F.col(c).cast("double")), 1)).alias(f"bad_{i}") for i, c in enumerate(covariates)]
    if start:
        checks.append(F.max(F.when(F.col(start) >= F.col(stop), 1)).alias("order"))
    if weight:
        checks += [F.max(F.when(F.col(weight) < 0, 1)).alias("below"), F.max(F.when(F.col(weight) != F.floor(weight), 1)).alias("parts")]
    got = df.agg(*checks).first()
    if not got["n"]:
        raise ValueError("no rows are left after those with nulls are dropped")
    if got["codes"]:
        raise ValueError(f"{event} must be 0 or 1")
    for i, c in enumerate(covariates):
        if got[f"bad_{i}"]:
            raise ValueError(f"{c} has values that are not finite")
    if start and got["order"]:
        raise ValueError("stop must be after start")
    if weight and got["below"]:
        raise ValueError(f"{weight} must not be negative")
    if weight and whole and got["parts"]:
        raise ValueError("with Efron's ties weights are numbers of equal rows; use Breslow's for fractions")
    return int(got["deaths"])


def death_times(df: DataFrame, stop: str = "stop", event: str = "event", by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(event) == 1).groupBy(*by, stop).agg(F.count("*").alias("deaths"))


def at_death_times(df: DataFrame, stop: str = "stop", event: str = "event") -> DataFrame:
    """Rows whose stop is some row's death time: all that the aligned likelihood reads."""
    return df.join(death_times(df, stop, event).select(stop), stop, "left_semi")


def ever_at_risk(df: DataFrame, start: str = "start", stop: str = "stop", event: str = "event") -> DataFrame:
    """Rows whose interval covers a death time (start < t <= stop); the others bear on no risk set."""
    t = df.where(F.col(event) == 1).select(F.col(stop).alias("__t")).distinct().withColumn("__n", F.lit(1).cast("long"))
    return ordered.up_to(df, t, "__t", ["__n"], [start, stop]).where(F.col(f"__n_{start}") < F.col(f"__n_{stop}")).select(*df.columns)


def up_to_event(df: DataFrame, event: str = "event") -> DataFrame:
    """Drop cells after the event, which are coded 2 and more."""
    return df.where(F.col(event) <= 1)


def flag_after_event(df: DataFrame, id: str, time: str, event: str) -> DataFrame:
    """Add 2 for each earlier event of the subject."""
    before = F.sum(event).over(Window.partitionBy(id).orderBy(time).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(event, (F.col(event) + 2 * F.coalesce(before, F.lit(0))).cast("int"))


def split_at(df: DataFrame, cuts: DataFrame, start: str = "start", stop: str = "stop", event: str = "event") -> DataFrame:
    """Cut intervals at the times of cuts (one column); the event stays on an interval's last part. Equal rows stay as many.

    A row's cuts are those numbered from the first after its start to the last before its stop, and meet their times by number.
    """
    t = cuts.columns[0]
    at = ordered.dense_ranks(cuts.select(F.col(t).alias("__t")), "__t", "__no").withColumn("__n", F.lit(1).cast("long"))
    rows = ordered.up_to(df, at, "__t", ["__n"], [start, stop])
    # before the stop: a cut at the stop itself is the end that the interval has anyway
    ends = rows.join(at.select(F.col("__t").alias("__at_stop"), F.lit(1).alias("__is")), F.col(stop) == F.col("__at_stop"), "left")
    last = F.col(f"__n_{stop}") - F.coalesce("__is", F.lit(0))
    parts = ends.select(*df.columns, F.explode(F.sequence(F.col(f"__n_{start}"), F.greatest(last, F.col(f"__n_{start}")))).alias("__no"), last.alias("__last"), F.col(f"__n_{start}").alias("__first"))
    times = at.select("__no", "__t")
    parts = parts.join(times, "__no", "left").withColumnRenamed("__t", "__end").withColumn("__before", F.col("__no") - 1)
    parts = parts.join(times.select(F.col("__no").alias("__before"), F.col("__t").alias("__begin")), "__before", "left")
    is_last = F.col("__no") >= F.col("__last")
    changed = {
        start: F.when(F.col("__no") == F.col("__first"), F.col(start)).otherwise(F.col("__begin")), stop: F.when(is_last, F.col(stop)).otherwise(F.col("__end")),
        event: F.when(is_last, F.col(event)).otherwise(0),
    }
    return parts.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])


def merge_times(df: DataFrame, column: str, digits: int = 9) -> DataFrame:
    """Make times equal that a chain of steps of less than 10**-digits joins: each becomes the least of its chain.

    Chains are found over distinct times, in ranges of times and then across the ranges' edges. Steps are rounded to six digits more, so that one of 10**-digits is none whatever
    the difference of the two times rounds to.
    """
    step = 10.0**-digits
    times = df.select(F.col(column).alias("__t")).where("__t IS NOT NULL").distinct()
    times = ordered.ranges(times, ["__t"])
    edges = times.groupBy("__range").agg(F.max("__t").alias("__last"))
    # a row a range
    edges = edges.select("__range", F.max("__last").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__edge"))
    before = F.coalesce(F.lag("__t").over(Window.partitionBy("__range").orderBy("__t")), F.col("__edge"))
    marked = times.join(edges, "__range").withColumn("__new", (before.isNull() | (F.round(F.col("__t") - before, digits + 6) >= step)).cast("long"))
    chains = ordered.prefix_sums(marked.select("__t", "__new"), "__t", ["__new"])
    least = chains.groupBy("__new").agg(F.min("__t").alias("__least"))
    named = chains.join(least, "__new").select("__t", "__least")
    return df.join(named, F.col(column) == F.col("__t"), "left").select(*[F.col("__least").alias(c) if c == column else F.col(c) for c in df.columns])


def one_hot(df: DataFrame, column: str, levels: Sequence) -> DataFrame:
    """0/1 columns of all levels but the first."""
    return df.select("*", *[(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in levels[1:]])


def interval_check(df: DataFrame, id: str = "id", start: str = "start", stop: str = "stop") -> DataFrame:
    """(id, start, stop, position, gap): place among the subject's intervals and sign of the gap to the one before.

    position: 1 first, 2 last, 3 both, 0 neither; gap: 0 none, 1 a gap, -1 an overlap, null for the first.
    """
    order = Window.partitionBy(id).orderBy(stop, start)
    before = F.lag(stop).over(order)
    first, last = before.isNull(), F.lead(stop).over(order).isNull()
    return df.select(id, start, stop, (first.cast("int") + 2 * last.cast("int")).alias("position"), F.signum(F.col(start) - before).cast("int").alias("gap"))


def state_flags(df: DataFrame, id: str, start: str, stop: str, before: str, after: str) -> DataFrame:
    """df with overlap (an interval begins before the subject's last one ends), gap, jump (a gap, and another state after it) and teleport (another state without a gap); all false for a subject's first.

    before and after: the state at an interval's start and end.
    """
    order = Window.partitionBy(id).orderBy(stop, start)
    end, other = F.lag(stop).over(order), F.col(before) != F.lag(after).over(order)
    marks = {"overlap": F.col(start) < end, "gap": F.col(start) > end, "jump": (F.col(start) > end) & other, "teleport": (F.col(start) == end) & other}
    return df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in marks.items()})


def state_check(df: DataFrame, id: str, start: str, stop: str, before: str, after: str) -> DataFrame:
    """How many intervals have each of state_flags."""
    rows = state_flags(df, id, start, stop, before, after)
    return rows.agg(*[F.count(F.when(F.col(c), 1)).alias(f"{c}s") for c in ("overlap", "gap", "jump", "teleport")])


def transitions(df: DataFrame, id: str, time: str, state: str) -> DataFrame:
    """Counts of (state before, state now) along each subject's rows."""
    order = Window.partitionBy(id).orderBy(time)
    moved = df.select(F.lag(state).over(order).alias("from_state"), F.col(state).alias("to_state"))
    return moved.where("from_state IS NOT NULL").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def carry_forward(df: DataFrame, id: str, time: str, columns: Sequence[str]) -> DataFrame:
    """Last observation carried forward over nulls."""
    order = Window.partitionBy(id).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[F.last(c, ignorenulls=True).over(order).alias(c) if c in columns else F.col(c) for c in df.columns])


def to_intervals(df: DataFrame, id: str, time: str, status: str, carried: Sequence[str]) -> DataFrame:
    """Rows of a visit table to intervals: covariates of a row, end point of the next."""
    order = Window.partitionBy(id).orderBy(time)
    out = df.select(id, F.col(time).alias("start"), F.lead(time).over(order).alias("stop"), F.lead(status).over(order).alias("event"), *carried)
    return out.where("stop IS NOT NULL")


def _beside(df: DataFrame, new: DataFrame, id: str, time: str, new_time: str, value: str):
    """Rows of both tables in one ordered stream; the new rows of a time come before the others'."""
    rows = df.select("*", F.lit(None).cast(new.schema[value].dataType).alias("__v"), F.lit(1).alias("__own"), F.col(time).alias("__at"))
    added = new.select(F.col(id), F.col(value).alias("__v"), F.lit(0).alias("__own"), F.col(new_time).alias("__at"))
    both = rows.unionByName(added, allowMissingColumns=True)
    return both, Window.partitionBy(id).orderBy("__at", "__own").rowsBetween(Window.unboundedPreceding, 0)


def merge_cumulative(df: DataFrame, new: DataFrame, id: str, time: str, new_time: str, value: str, out: str) -> DataFrame:
    """Sum of the new rows' values up to each row's time."""
    both, order = _beside(df, new, id, time, new_time, value)
    return both.withColumn(out, F.coalesce(F.sum("__v").over(order), F.lit(0))).where("__own = 1").select(*df.columns, out)


def merge_last(df: DataFrame, new: DataFrame, id: str, time: str, new_time: str, value: str, out: str) -> DataFrame:
    """As-of join: value of the last new row up to each row's time, null if there is none."""
    both, order = _beside(df, new, id, time, new_time, value)
    return both.withColumn(out, F.last("__v", ignorenulls=True).over(order)).where("__own = 1").select(*df.columns, out)


def last_rows(df: DataFrame, id: str, time: str) -> DataFrame:
    last = df.groupBy(id).agg(F.max_by(F.struct(*df.columns), time).alias("r"))
    return last.select("r.*")
