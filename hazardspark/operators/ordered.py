"""Ordered operators whose windows are of bounded size: prefix sums, as-of lookups, counts below, runs, ranks and shifts.

They cut an ordered table into ranges of about equal numbers of rows, whatever the values are, and work within ranges and over the ranges' totals. The ranges are
written to the scratch folder, so that the table behind them is computed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.sources.scratch import written


def ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with __range, the number of the row's range in order of keys; of the ranges all keys of one are before all of the next."""
    return written(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))


def numbered(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """df with the number from 0 of each row in order of keys."""
    rows = ranges(df, keys)
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    # a row a range
    base = counts.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return rows.join(base, "__range").withColumn(out, (F.col("__base") + rank).cast("long")).drop("__range", "__base")


def prefix_sums(df: DataFrame, time: str, values: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """df with values replaced by their sums over all rows of by up to (or, descending, from) the row's time.

    df has one row a time and group. Sums are taken within ranges of rows and over the ranges' totals, so no window holds all times.
    """
    rows = ranges(df, [*by, time])
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = rows.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__t_{i}") for i, c in enumerate(values)])
    over = Window.partitionBy(*by, F.lit(0)).orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    # a row a range and group
    totals = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__t_{i}").over(over), F.lit(0)).alias(f"__b_{i}") for i in range(len(values))])
    within = Window.partitionBy(*by, "__range").orderBy(order(time)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(totals, [*by, "__range"])
    sums = {c: F.col(f"__b_{i}") + F.sum(c).over(within) for i, c in enumerate(values)}
    return rows.select(*[sums[c].alias(c) if c in sums else F.col(c) for c in df.columns])


def up_to(df: DataFrame, marks: DataFrame, time: str, values: Sequence[str], at: Sequence[str]) -> DataFrame:
    """df with columns {value}_{column}: the sum of marks' values up to the time in each of the columns at.

    marks: time and values. The sums are looked up by equality, for distinct times of both tables; no row meets more than one of them.
    """
    times = df.select(F.explode(F.array(*[F.col(c) for c in at])).alias("__time"))
    times = times.where("__time IS NOT NULL").distinct().select("__time", *[F.lit(0).cast(marks.schema[v].dataType).alias(v) for v in values])
    both = times.union(marks.select(F.col(time).alias("__time"), *values)).groupBy("__time").agg(*[F.sum(v).alias(v) for v in values])
    sums = prefix_sums(both, "__time", values)
    for c in at:
        named = sums.select(F.col("__time").alias("__at"), *[F.col(v).alias(f"{v}_{c}") for v in values])
        df = df.join(named, F.col(c) == F.col("__at"), "left").drop("__at")
    return df


def counts_below(points: DataFrame, queries: DataFrame, levels: int, by: Sequence[str] = ()) -> DataFrame:
    """queries (q, pos, rank, and by) with below, equal and all: weights of points (pos, rank, n) of pos at least the query's, by rank, among those of the query's by.

    Ranks are whole numbers below 2**levels. A point counts in one node of each level of a binary tree over ranks, and what lies below a query
    is the nodes to the left of its path, so the work grows with rows times levels, and no pairs are made.
    """
    node = lambda level: F.call_function("shiftright", F.col("rank"), level)
    of_points = points.select(*by, "pos", "rank", "n", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    of_points = of_points.select(*by, "level", node(F.col("level")).alias("node"), "pos", "n").groupBy(*by, "level", "node", "pos").agg(F.sum("n").alias("n"))
    place = lambda level, at, kind: F.struct(level.alias("level"), at.alias("node"), F.lit(kind).alias("kind"))
    left = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda level: F.when(node(level) % 2 == 1, place(level, node(level) - 1, "below")))
    ends = F.array(place(F.lit(0), node(F.lit(0)), "equal"), place(F.lit(levels), node(F.lit(levels)), "all"))
    asked = written(queries.select(*by, "q", "pos", F.inline(F.concat(F.filter(left, lambda x: x.isNotNull()), ends))))
    places = asked.select(*by, "level", "node", "pos", F.lit(0).cast("long").alias("n")).union(of_points.select(*by, "level", "node", "pos", F.col("n").cast("long")))
    sums = prefix_sums(places.groupBy(*by, "level", "node", "pos").agg(F.sum("n").alias("n")), "pos", ["n"], [*by, "level", "node"], descending=True)
    found = asked.join(sums, [*by, "level", "node", "pos"])
    return found.groupBy(*by, "q").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("below", "equal", "all")])


def dense_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): distinct values and their places from 0."""
    return numbered(df.select(value).where(F.col(value).isNotNull()).distinct(), [value], out)


def runs(df: DataFrame, time: str, out: str = "run") -> DataFrame:
    """df with the number from 1 of its run of equal times, in order of time."""
    ranks = dense_ranks(df, time, out).select(F.col(time).alias("__v"), (F.col(out) + 1).alias(out))
    return df.join(ranks, F.col(time).eqNullSafe(F.col("__v"))).drop("__v")


def suffix_sums(df: DataFrame, time: str, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """df (one row a time and group) with the sum of value over its own and later times."""
    return prefix_sums(df.withColumn(out, F.col(value)), time, [out], by, descending=True)


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """df with ecdf (share of the group's rows up to the value) and rank (rows below it, and one), nulls left out.

    Both come from counts of distinct values, so equal values of very many rows are one row of the sums.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    sums = prefix_sums(counts.withColumn("__up", F.col("__n")), value, ["__up"], by)
    whole = counts.groupBy(*by).agg(F.sum("__n").alias("__all")) if by else None
    total = F.col("__all") if by else F.lit(counts.agg(F.sum("__n")).first()[0] or 0)
    sums = sums.join(whole, list(by)) if by else sums
    return df.join(sums.select(*by, value, (F.col("__up") / total).alias("ecdf"), (F.col("__up") - F.col("__n") + 1).alias("rank")), [*by, value])


def logit_ranks(df: DataFrame, time: str, value: str, out: str = "obrien") -> DataFrame:
    """df with log-odds-like scores (r - 0.5) / (0.5 + n - r) of the average rank r of value among the n rows of its time."""
    counts = df.groupBy(time, value).agg(F.count("*").alias("__m"))
    ranked = prefix_sums(counts.withColumn("__up", F.col("__m")), value, ["__up"], [time]).join(counts.groupBy(time).agg(F.sum("__m").alias("__all")), time)
    r = F.col("__up") - F.col("__m") + 1 + (F.col("__m") - 1) / 2
    return df.join(ranked.select(time, value, ((r - 0.5) / (0.5 + F.col("__all") - r)).alias(out)), [time, value])


def preceded_by(id: str, time: str, condition: Column, steps: int) -> Column:
    """Whether the condition holds on each of the last steps rows of the subject before this one."""
    order = Window.partitionBy(id).orderBy(time)
    out = F.lit(True)
    for k in range(1, steps + 1):
        out = out & F.coalesce(F.lag(condition, k).over(order), F.lit(False))
    return out
