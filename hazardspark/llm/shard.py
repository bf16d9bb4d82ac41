"""Uniform sharding with exact sizes by a hypergeometric communication matrix.

Rows are dealt by a keyed hash into virtual partitions of bounded size. How many rows of each
partition go to each shard is drawn exactly: row by row of a matrix whose margins are the counted
partition sizes and the shard sizes, from the multivariate hypergeometric law, which is what a
uniform permutation of all rows would give. A keyed rank within the partition (the local
permutation) then says which rows those are; after the exchange a second keyed order, within blocks
of bounded size of the shard, gives the slots. Only the counts, at most ``MAX_PARTITIONS`` rows, meet
on the driver. All steps on rows are DataFrame expressions and windows over bounded groups.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import materialize, packed, unpacked

#: Rows that a virtual partition or a block of a shard holds on average.
GROUP_ROWS = 50_000
#: Partitions or blocks at most; beyond GROUP_ROWS * MAX_PARTITIONS rows the groups grow instead.
MAX_PARTITIONS = 65_536


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts[p, s] with row sums sizes and column sums shards, as a uniform permutation would have them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.asarray(shards, dtype=np.int64)
    if int(left.sum()) != sum(sizes):
        raise ValueError("partition and shard sizes differ in sum")
    out = np.zeros((len(sizes), len(shards)), dtype=np.int64)
    for p, n in enumerate(sizes):
        rest, total = n, int(left.sum())
        for s in range(len(shards) - 1):
            total -= int(left[s])
            out[p, s] = hypergeometric(rng, int(left[s]), total, rest)
            rest -= int(out[p, s])
        out[p, -1] = rest
        left = left - out[p]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws are good ones, exact at any size: by inversion of the law around its mode.

    The chances are built up from ratios of neighbours, over 40 standard deviations on both sides and at least 100 values: what lies beyond is
    less than a double resolves.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = 100 + int(40 * math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))))
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) / (k[1:])) + np.log((draws - k[:-1]) / (float(bad - draws) + k[1:]))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(chances, rng.random() * chances[-1], side="right")])


def shard(df: DataFrame, shards: int = 16, seed: int = 7, group_rows: int = GROUP_ROWS) -> DataFrame:
    """df with columns ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one row at most. Rows are told apart by a hash over all their columns: which
    shard equal rows get is settled among themselves. Nulls are values like others; an empty table gives
    an empty table; columns of df named shard or slot are replaced, all others stay. Texts of any length are a hash here.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(packed(own).alias("own"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in own]).alias("key"))
    n = df.count()
    blocks = max(1, min(MAX_PARTITIONS, math.ceil(n / group_rows)))
    inner = max(1, min(MAX_PARTITIONS // shards, math.ceil(n / shards / group_rows)))
    keyed = df.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(blocks)).cast("int"))
    counts = dict(keyed.groupBy("part").count().collect())
    sizes = [counts.get(p, 0) for p in range(blocks)]
    matrix = communication_matrix(sizes, [n // shards + (s < n % shards) for s in range(shards)], seed)
    ends = df.sparkSession.createDataFrame([(p, [int(x) for x in row]) for p, row in enumerate(matrix.cumsum(axis=1))], "part int, ends array<long>")
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 2), "key"), "key")
    # ends: at most MAX_PARTITIONS rows
    dealt = keyed.withColumn("rank", F.row_number().over(local) - 1).join(F.broadcast(ends), "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 3), "key"), F.lit(inner)).cast("int"))
    dealt = materialize(dealt.select("own", "key", "shard", "block"))
    before = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = before.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    again = Window.partitionBy("shard", "block").orderBy(F.xxhash64(F.lit(seed + 4), "key"), "key")
    out = dealt.withColumn("at", F.row_number().over(again) - 1)
    # before: at most MAX_PARTITIONS rows
    out = out.join(F.broadcast(before.select("shard", "block", "base")), ["shard", "block"])
    return out.select(*unpacked(own), "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"))
