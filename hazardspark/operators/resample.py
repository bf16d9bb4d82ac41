"""Bootstrap weights and permutations from a portable hash, the same in Spark, SQL and numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardspark.operators import ordered

P = 2_147_483_647
#: Rows that are drawn together.
DRAW_BLOCK = 4096
#: Rows whose weights are made together, draws that are made together, and replicates of one array of weights.
WEIGHT_BLOCK, DRAWN, SLICE = 1 << 15, 1 << 20, 64
#: Ranges of a hash over which places of a permutation are counted.
BUCKETS = 1024


def portable_hash(i, b, seed: int):
    """Three rounds of arithmetic modulo a Mersenne prime, on columns or integer arrays of values below 2**31."""
    h = (i * 48271 + b * 69621 + seed) % P
    h = (h * h % P + h * 16807 + 12345) % P
    return (h * h % P + h * 48271 + b) % P


def _columns(i: Column, b: Column, seed: int) -> Column:
    return portable_hash(i.cast("long"), b.cast("long"), seed)


def dense_index(df: DataFrame, id: str, order: str | Sequence[str], out: str = "i") -> DataFrame:
    """Index from 0 in order of (id, order)."""
    keys = [id, *([order] if isinstance(order, str) else order)]
    return ordered.numbered(df, list(dict.fromkeys(keys)), out)


def draws(spark: SparkSession, n: int, replicates: int, seed: int = 1) -> DataFrame:
    """(b, i, w): how often replicate b draws index i of n; replicate 0 is the sample itself. Absent is 0."""
    cells = spark.range(replicates * n).select((F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("j"))
    i = F.when(F.col("b") == 0, F.col("j")).otherwise(_columns(F.col("j"), F.col("b"), seed) % n)
    return cells.select("b", i.alias("i")).groupBy("b", "i").agg(F.count("*").alias("w"))


def draws_of(n: int, b: int, seed: int = 1) -> np.ndarray:
    """Weights of one replicate, in a task."""
    if b == 0:
        return np.ones(n, dtype=np.int64)
    return np.bincount(portable_hash(np.arange(n, dtype=np.int64), np.int64(b), seed) % n, minlength=n)


def row_bootstrap(df: DataFrame, replicates: int, seed: int = 1, id: str = "id", order: str | Sequence[str] = "stop") -> DataFrame:
    """df's rows with replicate b and weight w."""
    indexed = dense_index(df, id, order)
    return indexed.join(draws(df.sparkSession, df.count(), replicates, seed), "i")


class SplitDraws:
    """How many of a replicate's draws, as many as all rows, fall into each block of the rows.

    Draws are split down a binary tree over the blocks, by a binomial draw at each node on the way to a block. A node's draw depends on seed, replicate and node only, so the blocks'
    tasks agree on it without a message; the numbers of all blocks have the multinomial law and sum to the rows.
    """

    def __init__(self, rows: int, block: int = DRAW_BLOCK, seed: int = 1):
        self.rows, self.block, self.seed = rows, block, seed
        self.known: dict[tuple[int, int, int], int] = {}

    def count(self, part: int, b: int) -> int:
        if b == 0:
            return min(self.block, self.rows - part * self.block)
        low, high, n = 0, -(-self.rows // self.block), self.rows
        while high - low > 1:
            mid = (low + high) // 2
            if (b, low, high) not in self.known:
                share = (mid - low) * self.block / (min(self.rows, high * self.block) - low * self.block)
                self.known[b, low, high] = int(np.random.default_rng([self.seed, b, low, high]).binomial(n, share))
            left = self.known[b, low, high]
            low, high, n = (low, mid, left) if part < mid else (mid, high, n - left)
        return n

    def weights(self, part: int, b: int) -> np.ndarray:
        """Of the block's rows; replicate 0 is the sample itself. A single block draws what draws_of does."""
        size = min(self.block, self.rows - part * self.block)
        if b == 0:
            return np.ones(size, dtype=np.int64)
        j = np.arange(self.count(part, b), dtype=np.int64)
        return np.bincount(portable_hash(j, np.int64(b), (self.seed + 7919 * part) % P) % size, minlength=size)


def split_bootstrap(df: DataFrame, replicates: int, seed: int = 1, id: str = "id", order: str | Sequence[str] = "stop", keep: Sequence[str] | None = None, block: int = DRAW_BLOCK, at_once: int = 256) -> DataFrame:
    """df's columns (or keep) with replicate b and weight w > 0, where no table of draws is made or shuffled.

    Rows are numbered in order of (id, order) and drawn block by block, each in the task that holds it: its number of draws comes down a tree (SplitDraws), its rows from the portable
    hash. Equal rows of keep are one in a block, with their weights' sum. Tables of one block have the draws of row_bootstrap. A task makes at_once replicates of a block.
    """
    keys = list(dict.fromkeys([id, *([order] if isinstance(order, str) else order)]))
    keep = list(df.columns if keep is None else keep)
    rows = ordered.numbered(df, keys, "__n")
    total = rows.count()
    slices = F.explode(F.sequence(F.lit(0), F.lit(max(0, replicates - 1) // at_once))).alias("__slice")
    rows = rows.select(F.floor(F.col("__n") / block).alias("__part"), slices, "__n", *keep)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__n")
        part, first, cells = int(table["__part"][0].as_py()), table["__slice"][0].as_py() * at_once, table.select(keep)
        draws, out = SplitDraws(total, block, seed), []
        for b in range(first, min(replicates, first + at_once)):
            w = draws.weights(part, b)
            some = np.flatnonzero(w)
            drawn = cells.take(pa.array(some)).append_column("w", pa.array(w[some])).group_by(keep).aggregate([("w", "sum")])
            out.append(drawn.select([*keep, "w_sum"]).rename_columns([*keep, "w"]).append_column("b", pa.array(np.full(len(drawn), b))))
        return pa.concat_tables(out).select([*keep, "b", "w"])

    kinds = T.StructType([*[df.schema[c] for c in keep], T.StructField("b", T.LongType()), T.StructField("w", T.LongType())])
    # block rows a group
    return rows.groupBy("__part", "__slice").applyInArrow(run, kinds)


def block_draws(spark: SparkSession, n: int, replicates: int, seed: int = 1, block: int = WEIGHT_BLOCK) -> DataFrame:
    """(__part, __slice, b, at): the draws of draws_of that fall into each block of n rows, as packed places in the block; replicate 0 is the sample and has none."""
    parts = -(-n // DRAWN)

    def run(batches):
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                b, k = divmod(cell, parts)
                if b == 0:
                    continue
                j = np.arange(k * DRAWN, min(n, (k + 1) * DRAWN), dtype=np.int64)
                i = np.sort(portable_hash(j, np.int64(b), seed) % n)
                some = np.unique(i // block)
                low, high = np.searchsorted(i, some * block), np.searchsorted(i, (some + 1) * block)
                packed = [(i[f:l] - p * block).astype("<u2").tobytes() for p, f, l in zip(some, low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), b // SLICE)), pa.array(np.full(len(some), b)), pa.array(packed, pa.binary())], ["__part", "__slice", "b", "at"])

    tasks = max(1, min(replicates * parts, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, replicates * parts, numPartitions=tasks).mapInArrow(run, "__part long, __slice long, b long, at binary")


def weighted_bootstrap(df: DataFrame, replicates: int, seed: int, order: Sequence[str], keep: Sequence[str], block: int = WEIGHT_BLOCK) -> DataFrame:
    """df's columns keep with __slice and w, the weights of the replicates from __slice * SLICE on, those of draws and draws_of for tables of any size.

    Rows are numbered in order. Draws are made where no row lies and travel as two bytes each to the block of rows that they fall into. Equal rows of keep are one in a block, with
    their weights' sums; rows that no replicate of a slice draws are left out of it.
    """
    if block > 1 << 16:
        raise ValueError("places in a block are two bytes")
    keep = list(keep)
    rows = ordered.numbered(df, list(order), "__n")
    total = rows.count()
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, replicates - 1) // SLICE).cast("long"))).alias("__slice")
    kind = pa.list_(pa.field("element", pa.int32()))
    rows = rows.select(F.floor(F.col("__n") / block).alias("__part"), slices, (F.col("__n") % block).cast("int").alias("__at"), *keep)

    def run(table: pa.Table, draws: pa.Table) -> pa.Table:
        if not len(table):
            return table.select([*keep, "__slice"]).append_column("w", pa.array([], kind))
        which = table["__slice"][0].as_py()
        weights = np.zeros((block, SLICE), dtype=np.int32)
        if which == 0:
            weights[:, 0] = 1
        for b, at in zip(draws["b"].to_pylist(), draws["at"].to_pylist()):
            weights[:, b - which * SLICE] += np.bincount(np.frombuffer(at, dtype="<u2"), minlength=block).astype(np.int32)
        cells = table.select([*keep, "__slice", "__at"]).combine_chunks().group_by([*keep, "__slice"], use_threads=False).aggregate([("__at", "list")]).combine_chunks()
        places = cells["__at_list"].chunk(0)
        sums = np.add.reduceat(weights[places.flatten().to_numpy()], places.offsets.to_numpy()[:-1] - places.offsets[0].as_py(), axis=0, dtype=np.int32)
        some = np.flatnonzero(sums.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * SLICE, pa.int32()), pa.array(sums[some].ravel()), kind)
        return cells.select([*keep, "__slice"]).take(pa.array(some)).append_column("w", lists)

    kinds = T.StructType([*[df.schema[c] for c in keep], T.StructField("__slice", T.LongType()), T.StructField("w", T.ArrayType(T.IntegerType()))])
    draws = block_draws(df.sparkSession, total, replicates, seed, block)
    # block rows, and the draws of SLICE replicates that fall on them
    return rows.groupBy("__part", "__slice").cogroup(draws.groupBy("__part", "__slice")).applyInArrow(run, kinds)


def subject_bootstrap(df: DataFrame, replicates: int, seed: int = 1, id: str = "id") -> DataFrame:
    """df's rows with replicate b and the weight w of their subject."""
    ids = dense_index(df.select(id).distinct(), id, id)
    weights = ids.join(draws(df.sparkSession, ids.count(), replicates, seed), "i").select(id, "b", "w")
    return df.join(weights, id)


def repeat_rows(df: DataFrame, weight: str = "w", copy: str = "copy") -> DataFrame:
    """Rows as often as their weight says, copies numbered from 1."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))).alias(copy))


def permutations(ids: DataFrame, count: int, seed: int = 1, id: str = "id") -> DataFrame:
    """(p, id, other): in permutation p, id gets the exposure of other; permutation 0 is the identity.

    Places of a permutation are ranks of a hash, taken within ranges of the hash and over the ranges' counts.
    """
    base = dense_index(ids.select(id).distinct(), id, id).select(id, "i")
    rows = base.select(id, "i", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("p")) if count else base.select(id, "i", F.lit(1).alias("p")).limit(0)
    rows = rows.withColumn("h", _columns(F.col("i"), F.col("p"), seed)).withColumn("range", F.floor(F.col("h") / (P // BUCKETS + 1)))
    counts = rows.groupBy("p", "range").agg(F.count("*").alias("n"))
    # at most BUCKETS rows a permutation
    before = counts.select("p", "range", F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("p", "range").orderBy("h", "i")) - 1
    rows = rows.join(before, ["p", "range"]).withColumn("k", F.col("before") + rank)
    moved = rows.select("p", F.col("i").alias("at"), id).join(rows.select("p", F.col("k").alias("at"), F.col(id).alias("other")), ["p", "at"]).select("p", id, "other")
    return base.select(F.lit(0).alias("p"), id, F.col(id).alias("other")).union(moved)
