"""Texts of similar sets of word shingles: candidates, pigeonring pruning and verification for the SimHash operator.

Shingles are put in one order for all texts, rarest first. Two sets of sizes m and n of similarity t or more
share one of the first n - ceil(t * n) + 1 shingles of each (prefix filtering), so sharing one makes a candidate. Candidates whose
fingerprints (of the sets) fail the chains of a ring of segments within ``radius`` bits are pruned. Only the others' texts are read
again; the last 16 bits of their shingles bound the overlap from above, and for pairs within that bound whole sets decide. Any order gives the same groups; the counts behind it are of a sample.

A shared shingle of very many like texts is not paired: its members are first compared with one of them, and
only members that are then still in different groups are paired. Pairs whose odd sketches (which parts of the hash space hold an odd number of a set's elements)
differ in more bits than similar sets differ in elements are none, which is exact: each differing element turns one bit at most. So
edited copies that are far from similar to each other are told apart where they meet, and make no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardspark.llm.common import few, materialize, split_words
from hazardspark.llm.components import connected_components
from hazardspark.llm.ring import BITS, within

#: Rows whose shingles are counted for the order, and shingles whose counts are used.
ORDER_ROWS, ORDER_SHINGLES = 20_000, 50_000
#: Texts whose words are held at a time.
CHUNK = 256
#: Texts to be read again whose hashes (16 bytes each) are broadcast; more are joined.
AGAIN = 1_000_000
#: Differing bits of fingerprints, and segments. At similarity 0.8 fingerprints differ in 9.6 bits, with a standard deviation of 2.9 (sets of
#: five shingles: 12 and 3.1), so pairs beyond 28 bits are less than one in a million even there; unrelated pairs are beyond it in four of five cases.
RADIUS, SEGMENTS = 28, 8
#: Bits of an odd sketch, a multiple of 64.
SKETCH = 1024


#: Odd multipliers of the words of a shingle, from the last to the first, and of the final mix (fixed values).
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 9)], dtype=np.uint64)


def shingles(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Of each text the distinct hashes, ascending, of width consecutive words, A-Z lower-cased; fewer words: the whole sequence; no words: none.

    Words are hashed once each and combined, so all texts of a batch are hashed together.
    """
    words, of = split_words(texts)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w) for w in words.dictionary.to_pylist()] or [0], dtype=np.uint64)
    h = each[words.indices.to_numpy()] if len(words) else np.zeros(0, dtype=np.uint64)
    counts = np.bincount(of, minlength=len(texts))
    starts = np.cumsum(counts) - counts
    whole = np.zeros(len(h), dtype=np.uint64)
    for k in range(width):  # a text of fewer words has one shingle, of the words that there are
        there = np.zeros(len(h), dtype=bool)
        m = max(0, len(h) - k)
        there[:m] = of[:m] == of[k:]
        whole[there] += h[np.flatnonzero(there) + k] * _FACTORS[k]
    whole ^= whole >> np.uint64(31)
    whole *= _FACTORS[7]
    whole ^= whole >> np.uint64(29)
    values = whole.view(np.int64)
    return [np.unique(values[a : a + max(1, n - width + 1)]) if n else values[:0] for a, n in zip(starts.tolist(), counts.tolist())]


def set_print(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set of hashes: bits that are set in over half of them; no hashes: 0."""
    if not len(s):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(s), 8192):
        counts += np.unpackbits(s[at : at + 8192].astype(">i8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(s)).tobytes(), "big", signed=True)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH bits as signed 64-bit numbers: whether an odd number of these hashes fall on each."""
    odd = np.bincount(s & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def _map(df: DataFrame, schema: str, width: int, of: Callable[[np.ndarray], tuple]) -> DataFrame:
    """df's columns but the string __text, and the columns that of gives for the text's shingles."""
    new = T._parse_datatype_string(schema).fields
    kinds = [pa.list_(pa.int16() if f.dataType.elementType == T.ShortType() else pa.int64()) if isinstance(f.dataType, T.ArrayType) else pa.int64() for f in new]
    kept = [f for f in df.schema.fields if f.name != "__text"]

    def run(batches):
        for batch in batches:
            texts = batch.column("__text")
            rows = [of(s) for at in range(0, len(texts), CHUNK) for s in shingles(texts[at : at + CHUNK], width)]
            columns = [batch.column(f.name) for f in kept] + [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + [f.name for f in new])

    return df.mapInArrow(run, T.StructType(kept + new))


def _node(s: np.ndarray) -> int:
    return np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 7)).astype(np.int64) if len(s) else 0


def _common(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several rows of a sample, ascending, and their counts."""
    share = min(1.0, ORDER_ROWS / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64(F.lit(5), "__text"), F.lit(1 << 31)) < int(share * (1 << 31))).select("__text")
    counts = _map(some, "s array<long>", width, lambda s: (s,)).select(F.explode("s").alias("s"))
    counts = counts.groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(ORDER_SHINGLES).toPandas()
    counts = counts.sort_values("s")
    return counts["s"].to_numpy(dtype=np.int64), counts["count"].to_numpy(dtype=np.int64)


def _keys(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """rows without __text: node (a hash of the set), its size n, its fingerprint, its odd sketch, and the shingles of its prefix."""
    order = rows.sparkSession.sparkContext.broadcast(_common(rows, width))

    def of(s: np.ndarray) -> tuple:
        common, count = order.value
        n = len(s)
        if not n:
            return 0, 0, 0, odd_sketch(s), []
        most = n - -(-n * percent // 100) + 1
        at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
        known = common[at] == s if len(common) else np.zeros(n, dtype=bool)
        rare = s[~known]  # ascending, before all others
        if len(rare) < most:
            rest, weight = s[known], count[at[known]]
            rare = np.concatenate([rare, rest[np.lexsort((rest, weight))]])
        return _node(s), n, set_print(s), odd_sketch(s), rare[:most]

    return _map(rows, "node long, n long, fingerprint long, sketch array<long>, keys array<long>", width, of)


def _sets(wanted: DataFrame, rows: DataFrame, nodes: DataFrame, schema: str, width: int, of: Callable[[np.ndarray], tuple]) -> DataFrame:
    """The columns that of gives for the sets of the wanted nodes, their texts read again: as often as they occur, and kept once."""
    texts = few(nodes.join(wanted, "node", "left_semi").select("t1", "t2"), AGAIN)
    read = _map(rows.join(texts, ["t1", "t2"], "left_semi").select("__text"), schema, width, of)
    return materialize(read.groupBy("node").agg(*[F.first(c).alias(c) for c in read.columns if c != "node"]))


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike. rows: t1, t2 and __text; nodes: node and the t1 and t2 of one of its texts.

    The ends of shingles, a quarter of a set's bytes or less, are compared first; whole sets are written only for pairs that these leave.
    """
    members = lambda of: of.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    alike = F.col("both") * 100 >= percent * (F.col("x_n") + F.col("y_n") - F.col("both"))
    pairs = materialize(pairs)
    ends = _sets(members(pairs), rows, nodes, "node long, n long, s array<short>", width, lambda s: (_node(s), len(s), np.unique(s.astype(np.int16))))
    side = lambda sets, name, n, out: sets.select(F.col("node").alias(name), n.alias(f"{out}_n"), F.col("s").alias(out))
    # shared elements have shared ends; as many as a set's elements exceed its distinct ends may be missed
    likely = pairs.join(side(ends, "a", F.col("n"), "x"), "a").join(side(ends, "b", F.col("n"), "y"), "b")
    most = F.size(F.array_intersect("x", "y")) + F.col("x_n") - F.size("x")
    likely = materialize(likely.withColumn("both", most).where(alike).select("a", "b"))
    whole = _sets(members(likely), rows, nodes, "node long, s array<long>", width, lambda s: (_node(s), s))
    found = likely.join(side(whole, "a", F.size("s"), "x"), "a").join(side(whole, "b", F.size("s"), "y"), "b")
    return materialize(found.withColumn("both", F.size(F.array_intersect("x", "y"))).where(alike).select("a", "b"))


def _close(percent: int, radius: int | None) -> Column:
    """Whether a pair of rows x and y may be similar, by sizes and (unless radius is None) fingerprints."""
    n, m = F.col("x.n"), F.col("y.n")
    diff = F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return sizes if radius is None else sizes & within(diff, radius, SEGMENTS)


def _alike(percent: int) -> Column:
    """Whether the sketches of a pair of rows x and y leave it similar: similar sets differ in at most (100 - percent) / (100 + percent) of their sizes' sum."""
    turned = [F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH // 64)]
    return sum(turned[1:], turned[0]) * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)


def similar(docs: DataFrame, width: int = 5, percent: int = 80, stars: int = 6, bucket: int = 16, radius: int | None = RADIUS) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. (doc_id, node, fingerprint) of its rows, node naming a set of shingles, and (node, root) of nodes with links.

    Null texts, empty texts and texts without words have the empty set. Keys of more than bucket members go through at most stars rounds of
    comparisons with one member, as long as rounds link a tenth of them. radius: bits within which fingerprints must agree; None prunes nothing and so finds every pair for certain.
    Very long texts are compared whole, repeated rows are one node, other columns are ignored, whatever their names, and an empty table gives empty ones.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"), text.alias("__text"))
    prints = materialize(_keys(rows, width, percent))
    nodes = prints.groupBy("node").agg(F.min(F.struct("t1", "t2")).alias("t"), *[F.first(c).alias(c) for c in ("n", "fingerprint", "sketch")])
    nodes = materialize(nodes.select("node", "t.t1", "t.t2", "n", "fingerprint", "sketch"))
    keyed = prints.select("node", F.explode("keys").alias("key"))
    # most keys occur once, so they are counted first without their nodes; repeated texts, which repeat their keys, are one node then
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    met = materialize(keyed.join(shared, "key").distinct())
    # keys of the same members make the same pairs: one of them is enough
    sizes = met.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64(F.lit(3), "node")).alias("y")).where("size > 1")
    one = sizes.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    live = materialize(met.join(one, "key").join(nodes.select("node", "n", "fingerprint"), "node"))
    verified = lambda pairs: _verified(pairs, rows.select("t1", "t2", "__text"), nodes.select("node", "t1", "t2"), width, percent)
    links, before = None, None
    for salt in range(stars):
        crowded = live.where(F.col("size") > bucket)
        many = crowded.count()
        if not many or (before and many > 0.9 * before):
            break
        before = many
        # heads: the members of most crowded keys, which are most like the others, and in later rounds any
        degree = crowded.groupBy("node").agg((-F.count("*") if not salt else F.min(F.xxhash64(F.lit(salt), "node"))).alias("h"))
        head = crowded.join(degree, "node").groupBy("key").agg(F.min(F.struct("h", "node", "n", "fingerprint")).alias("r")).select("key", "r.*")
        x, y = crowded.alias("x"), head.alias("y")
        pairs = x.join(y, F.col("x.key") == F.col("y.key")).where((F.col("x.node") != F.col("y.node")) & _close(percent, radius))
        # one comparison a member and round: with the head of least h
        pairs = pairs.groupBy(F.col("x.node").alias("a")).agg(F.min(F.struct("y.h", "y.node")).alias("r")).select("a", F.col("r.node").alias("b"))
        found = verified(pairs)
        links = found if links is None else links.union(found)
        live = _parted(live.select("key", "node", "n", "fingerprint"), connected_components(links))
    sketched = materialize(live.join(nodes.select("node", "sketch"), "node"))
    x, y = sketched.alias("x"), sketched.alias("y")
    other = F.col("x.root") != F.col("y.root") if links is not None else F.lit(True)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & other)
    found = verified(pairs.where(_close(percent, radius) & _alike(percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    return prints.select("doc_id", "node", "fingerprint"), connected_components(found if links is None else links.union(found))


def _parted(live: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of keys whose members are in several groups, with their group and the key's number of members."""
    now = materialize(live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = now.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return materialize(now.join(several.select("key", "size"), "key"))
