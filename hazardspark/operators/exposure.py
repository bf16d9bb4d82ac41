"""Weighted cumulative exposure features: a bucketed range self-join with a spline table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.functions import splines


def within_reach(target: DataFrame, source: DataFrame, keys: Sequence[str], stop: str, reach: float) -> DataFrame:
    """target's rows (keys, stop, __bucket) beside the sources (keys, __s, ...) of the times from stop - reach, exclusive, up to stop; sources are null where there are none.

    Times fall into buckets as wide as the reach. A source is in its own bucket and in the next, so a row of the target meets all its sources in its bucket, and
    a history of N times makes pairs within buckets only, however long it is.
    """
    bucket = lambda t: F.floor(F.col(t) / reach)
    sources = source.withColumn("__bucket", F.explode(F.array(bucket("__s"), bucket("__s") + 1)))
    targets = target.withColumn("__bucket", bucket(stop))
    on = [*keys, "__bucket"]
    near = (F.col("s.__s") <= F.col(f"t.{stop}")) & (F.col("s.__s") > F.col(f"t.{stop}") - reach)
    pairs = targets.alias("t").join(sources.alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on] + [near], "left")
    return pairs.select(*[F.col(f"t.{k}") for k in [*on, stop]], *[F.col(f"s.{c}") for c in source.columns if c not in keys])


def features(df: DataFrame, values: np.ndarray, id: str = "id", stop: str = "stop", dose: str = "dose", by: Sequence[str] = ()) -> DataFrame:
    """by, id, stop and D1, D2, ...: sums over doses of the last len(values) times of dose * value[lag].

    Zero doses are dropped before the join, and the spline table (lags x columns, both set by arguments) is an array
    literal, so the join is an equi-join on by, id and a bucket of times, with the range as its residual; the sums need no further shuffle.
    """
    cutoff, count = values.shape
    keys = [*by, id]
    source = df.where(F.col(dose) != 0).groupBy(*keys, F.col(stop).alias("__s")).agg(F.sum(dose).alias("__dose"))
    pairs = within_reach(df.select(*keys, stop), source, keys, stop, cutoff)
    lag = (F.col(stop) - F.col("__s")).cast("int")

    def at(k: int):
        table = F.array(*[F.lit(float(x)) for x in values[:, k]])
        return F.coalesce(F.sum(F.col("__dose") * F.get(table, lag)), F.lit(0.0)).alias(f"D{k + 1}")

    return pairs.groupBy(*keys, "__bucket", stop).agg(*[at(k) for k in range(count)]).drop("__bucket")


def wce_features(df: DataFrame, cutoff: int, nknots: int = 1, order: int = 3, constrained: str | None = None, **columns) -> DataFrame:
    return features(df, splines.atoms(cutoff, nknots, order, constrained), **columns)
