"""Incremental risk-set counts over a stream of panel rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, covariates: Sequence[str] = (), stop: str = "stop", event: str = "event") -> DataFrame:
    """Rows by (stop, event, covariates), to be written in update or complete mode: what riskset.compact holds for a table."""
    return stream.groupBy(stop, event, *covariates).agg(F.count("*").alias("n"))


def daily_events(stream: DataFrame, time: str, late: str = "2 days") -> DataFrame:
    """Events and summed values by day and type, with a watermark for late rows."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
