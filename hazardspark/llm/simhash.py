"""SimHash near-duplicates, found with pigeonring filtering.

Fingerprints within a small ``radius`` share, by ring.py, consecutive whole segments: the leading run lengths whose budget is zero
make an equality key that Spark can join on; the longer runs are
then checked one by one, each against its proportional budget, before the full Hamming distance.

A bucket of one key may hold very many fingerprints (thousands of edits of one text). Buckets over
``bucket_pairs`` members are not paired: each member there names itself and all its single-bit
neighbours, and members that name a common value are linked to the smallest of them. Those links
are at most 2 bits long and join all pairs within 2 bits, with at most 65 rows a member.

With ``percent`` near-duplicates are texts whose sets of shingles are that similar (Jaccard). Their fingerprints differ in 10 bits of 64 or
more at 80 percent, where no whole segment need agree, so candidates there share a rare shingle (shingles.py); chains and Hamming distance
prune them, and whole sets decide.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardspark.llm.common import map_texts, materialize, text_bytes
from hazardspark.llm.components import connected_components
from hazardspark.llm.ring import BITS, chained, masks, ring, signed
from hazardspark.llm.shingles import RADIUS, similar


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Fingerprint of UTF-8 text, unsigned: a bit is set if it is set in over half of the shingles' hashes.

    Shingles: width consecutive words of the text with A-Z lower-cased, repeats included, joined by a
    space; fewer words: the whole sequence; no words: 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return digest(joined, seed)
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :])], dtype=">u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, seed: int = 42, out: str = "fingerprint") -> DataFrame:
    """docs without its text column, with the fingerprint as a (signed) long; null text counts as empty."""

    def make():
        def of(value: bytes) -> tuple[int]:
            h = simhash(value, width, seed)
            return (h - (1 << BITS) if h >> (BITS - 1) else h,)

        return of

    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], text_bytes(text).alias("__text"))
    return map_texts(rows, T.StructType([T.StructField(out, T.LongType())]), make)


def near_links(prints: DataFrame, fingerprint: str = "fingerprint", radius: int = 2, segments: int = 5, bucket_pairs: int = 64) -> DataFrame:
    """Links (a, b), a < b as longs, whose components are those of all pairs within radius bits.

    prints: distinct fingerprints. All pairs of small buckets are links; see the module's text for large ones
    (which need radius <= 2; beyond it every bucket is paired).
    """
    parts, budgets, zero = ring(radius, segments)
    if not zero:
        raise ValueError("need more segments than radius")
    keys = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(masks(parts, i, range(zero, zero + 1))[0])).alias("key")) for i in range(segments)]
    keyed = prints.select(F.col(fingerprint).alias("fp")).select("fp", F.inline(F.array(*keys)))
    shared = keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    live = materialize(keyed.join(shared, ["i", "key"]))
    small = live if radius > 2 else live.where(F.col("n") <= bucket_pairs)
    diff: Column = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    chain = F.lit(False)
    for i in range(segments):
        chain = chain | ((F.col("x.i") == i) & chained(diff, parts, budgets, i, zero))
    pairs = (
        small.alias("x").join(small.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
        .where(chain).where(F.bit_count(diff) <= radius)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    if radius > 2:
        return pairs.distinct()
    crowded = live.where(F.col("n") > bucket_pairs).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS)])
    named = crowded.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("z"))
    stars = named.groupBy("z").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, radius: int = 2, segments: int = 5, bucket_pairs: int | None = None, percent: int | None = None, prune: bool = True) -> DataFrame:
    """One row per row of docs: its doc_id, fingerprint (16 hex digits), component_id.

    Linked are fingerprints within radius bits or, with percent, texts of that similarity by sets of shingles (the fingerprint is then that of
    the set; radius and segments are shingles.similar's own, and without prune fingerprints decide nothing there). component_id is the smallest doc_id that links lead to, itself included; null only if all of those are null.
    Null texts, empty texts and texts without words have fingerprint zero and are linked like any other; very long texts are read whole; repeated
    rows give repeated results; other columns are ignored; an empty table gives an empty table.
    """
    if percent is not None:
        prints, of = similar(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), width, percent, bucket=bucket_pairs or 16, radius=RADIUS if prune else None)
    else:
        prints = fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), width=width, seed=seed)
        prints = materialize(prints.withColumn("node", F.col("fingerprint")))
        of = None
    first = prints.groupBy("node").agg(F.min("doc_id").alias("first"))
    if of is None:
        of = connected_components(near_links(first, "node", radius, segments, bucket_pairs or 64))
    of = first.join(of.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(smallest, "root").select("node", "component_id")
    return prints.join(of, "node").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
