"""Connected components by alternating large-star and small-star steps.

Each step is two aggregations and joins over edges of the present graph; every node ends
up pointing at the smallest node of its component after a number of rounds that grows with
the logarithm of the size. Minima are aggregated before the shuffle, and the join back to a
hub's edges is an equi-join whose skewed side Spark can split, so a hub is no one task's load.
Rounds are written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    edges: undirected, of two columns of one orderable type; loops and rows with nulls are dropped,
    repeated edges count once. An empty table gives an empty table.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        )
        now = materialize(small.select("e.*").where("a <> b").distinct())
        after = _mark(now)
        if after == before:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        before = after
    raise RuntimeError(f"components not settled after {rounds} rounds")
