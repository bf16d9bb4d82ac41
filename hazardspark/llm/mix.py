"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The rows of a source lie in a keyed random order on a line of words. Its target repeats that line
as often as needed and cuts it into blocks, so a target is an exact quota of blocks. The vector of
all sources' quotas is split among the output shards by a binary tree: at each node the left half
draws its share from the multivariate hypergeometric law. A leaf's quota of a source is a run of
that source's randomly permuted blocks, so shards are disjoint; within a shard, blocks lie in random
order and rows within a block in a keyed order (the local shuffle). The permutations are keyed bijections that
an expression computes block by block, so no list of blocks is held anywhere.

Prefix sums of words are taken in two levels, within buckets of bounded size and over the buckets of
a source, so a source with a third of all rows is no one task's load. On the driver meet one row per
source and its counts by shard (at most ``MAX_SOURCES`` rows).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import WORD_PATTERN, few, materialize, packed, unpacked
from hazardspark.llm.shard import hypergeometric

MAX_SOURCES = 1_000_000
#: Rows that a bucket of a source holds on average.
BUCKET_ROWS = 4_000


def word_count(text: Column) -> Column:
    """Words of a text, null as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size; the excess is shared again by weight."""
    out = [0.0] * len(sizes)
    open_, rest = set(i for i, s in enumerate(sizes) if s > 0), float(sum(sizes))
    while open_ and rest > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        rest -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks[shard, source]: quotas split among shards whose totals differ by one block at most."""
    total = sum(quotas)
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(low: int, high: int, have: np.ndarray) -> None:
        if high - low == 1:
            out[low] = have
            return
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = np.zeros_like(have)
        take, rest = sum(caps[low:middle]), int(have.sum())
        for i, n in enumerate(have.tolist()):  # one source after another: hypergeometric marginals
            rest -= n
            left[i] = hypergeometric(rng, n, rest, take)
            take -= int(left[i])
        split(low, middle, left)
        split(middle, high, have - left)

    split(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def permuted(x: Column, n: Column, *key: Column | int) -> Column:
    """The place of x among 0..n-1 in a keyed random order: a four-round Feistel network, walked until it is below n."""
    keys = [k if isinstance(k, Column) else F.lit(k) for k in key]
    bits = F.greatest(F.length(F.bin(n - 1)), F.lit(2))
    low = F.floor(bits / 2).cast("int")
    one = F.lit(1).cast("long")
    below = lambda width: F.call_function("shiftleft", one, width) - 1

    def turn(v: Column) -> Column:
        # halves change sides each round; the left one is bits - low wide at even rounds and low wide at odd ones
        def step(v: Column, r: Column) -> Column:
            right = F.when(r % 2 == 0, low).otherwise(bits - low)
            left = bits - right
            a = F.call_function("shiftright", v, right)
            b = v.bitwiseAND(below(right))
            mixed = a.bitwiseXOR(F.xxhash64(b, r, *keys).bitwiseAND(below(left)))
            return F.call_function("shiftleft", b, left).bitwiseOR(mixed)

        return F.aggregate(F.array(*[F.lit(r) for r in range(4)]), v, step)

    walk = F.sequence(F.lit(1), F.lit(80))  # a turn is below n with probability over a half
    return F.aggregate(walk, turn(x.cast("long")), lambda v, _: F.when(v < n, v).otherwise(turn(v)))


def mix(df: DataFrame, text: str = "text", source: str = "source", size: str | None = None, shards: int = 16, seed: int = 11, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, block_words: int = 4096) -> DataFrame:
    """df with columns size, source_size, target, taken and pieces.

    size: the row's words (from text, or the named column of df, which goes). Sources by code point, null last,
    weigh ``weights`` in turn. pieces: array of (epoch, from_word, n_words, shard, place, key): the parts of the
    row that the mix takes; place is the block's place in its shard and key the order within the block. taken: the
    words in pieces. A source's taken words are its target rounded, and no row is taken more than ``most`` times.
    Rows that are equal in all columns share their places among themselves; null and empty texts have size 0 and are never
    taken; a very long text is cut at blocks' ends into many pieces; ties of the keyed order are ties of equal rows; an empty table gives
    an empty table; columns of df with these five names are replaced, all others stay.
    """
    own = [c for c in df.columns if c not in ("size", "source_size", "target", "taken", "pieces", size)]
    words_ = F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long") if size else word_count(F.col(f"`{text}`"))
    # the caller's columns travel in one struct, so that names can't clash
    rows = df.select(packed(own).alias("own"), F.col(f"`{source}`").alias("s"), words_.alias("size"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in own]).alias("key"))
    rows = materialize(rows)
    spark = df.sparkSession
    sums = rows.groupBy("s").agg(F.sum("size").alias("w"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums.sort(key=lambda r: (r["s"] is None, str(r["s"]).encode("utf-32-be")))
    sizes = [int(r["w"]) for r in sums]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], most)
    words = [min(round(t), math.floor(most * s)) for t, s in zip(aims, sizes)]
    quotas = [math.ceil(w / block_words) for w in words]
    tree = splitting_tree(quotas, shards, seed)
    ends, bases, totals = tree.cumsum(axis=0), tree.cumsum(axis=1) - tree, tree.sum(axis=1).tolist()
    buckets = [max(1, math.ceil(r["n"] / BUCKET_ROWS)) for r in sums]
    facts = spark.createDataFrame(
        [(r["s"], i, sizes[i], float(aims[i]), words[i], buckets[i], quotas[i], ends[:, i].tolist(), bases[:, i].tolist()) for i, r in enumerate(sums)],
        f"s {rows.schema['s'].dataType.simpleString()}, i int, source_size long, target double, words long, buckets int, quota long, ends array<long>, bases array<long>",
    )
    # facts: a row a source
    facts = few(facts).select(F.col("s").alias("of"), "i", "source_size", "target", "words", "buckets", "quota", "ends", "bases")
    rows = rows.join(facts, F.col("s").eqNullSafe(F.col("of"))).drop("s", "of")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("buckets")).cast("int"))
    order = Window.partitionBy("i", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0)))
    starts = rows.groupBy("i", "bucket").agg(F.sum("size").alias("n"))
    starts = starts.select("i", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.join(starts, ["i", "bucket"]).withColumn("at", F.col("before") + F.col("within"))
    # the row's stretch on each repetition of its source's line, cut at the blocks' ends
    epochs = F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))
    stretch = F.transform(epochs, lambda e: F.struct(
        e.cast("int").alias("epoch"), (e * F.col("source_size") + F.col("at")).alias("low"),
        F.least(e * F.col("source_size") + F.col("at") + F.col("size"), F.col("words")).alias("high"),
    ))
    stretch = F.filter(stretch, lambda x: x["high"] > x["low"])
    width = F.lit(block_words).cast("long")
    cut = F.flatten(F.transform(stretch, lambda x: F.transform(
        F.sequence(F.floor(x["low"] / width), F.floor((x["high"] - 1) / width)),
        lambda b: F.struct(
            x["epoch"].alias("epoch"), b.alias("block"),
            (F.greatest(x["low"], b * width) - x["low"]).cast("long").alias("from_word"),
            (F.least(x["high"], (b + 1) * width) - F.greatest(x["low"], b * width)).cast("long").alias("n_words"),
        ),
    )))
    # a block's place in the random order of its source's blocks, the leaf that holds it, and its place there
    dealt = F.transform(cut, lambda x: F.struct(x["epoch"].alias("epoch"), x["from_word"].alias("from_word"), x["n_words"].alias("n_words"), permuted(x["block"], F.col("quota"), F.col("i"), seed).alias("rank")))
    dealt = F.transform(dealt, lambda x: F.struct(x["epoch"].alias("epoch"), x["from_word"].alias("from_word"), x["n_words"].alias("n_words"), x["rank"].alias("rank"), F.size(F.filter("ends", lambda e: e <= x["rank"])).alias("shard")))
    all_ = F.array(*[F.lit(int(t)).cast("long") for t in totals])

    def place(x: Column) -> Column:
        first = F.when(x["shard"] > 0, F.get("ends", x["shard"] - 1)).otherwise(F.lit(0).cast("long"))
        return permuted(F.get("bases", x["shard"]) + x["rank"] - first, F.get(all_, x["shard"]), x["shard"], seed + 3)

    pieces = F.transform("dealt", lambda x: F.struct(
        x["epoch"].alias("epoch"), x["from_word"].alias("from_word"), x["n_words"].alias("n_words"), x["shard"].cast("int").alias("shard"),
        place(x).alias("place"), F.xxhash64(F.lit(seed + 2), "key", x["epoch"]).alias("key"),
    ))
    rows = rows.withColumn("dealt", dealt).withColumn("pieces", pieces)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, x: s + x["n_words"])
    return rows.select(*unpacked(own), "size", "source_size", "target", taken.alias("taken"), "pieces")
