"""Tables in the scratch folder, which cut lineage: what reads them reads files, not the plan that made them."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="hazardspark-scratch-")


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where it is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of the scratch folder, which an executor's loss doesn't touch."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
