import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazardspark.llm import mix, shard
from hazardspark.llm.queries import op7_hypergeometric_sharding, op10_source_mixing
from tests.llm import data


def test_communication_matrix_has_both_margins():
    m = shard.communication_matrix([10, 0, 7, 3], [8, 7, 5], 1)
    assert m.sum(axis=1).tolist() == [10, 0, 7, 3] and m.sum(axis=0).tolist() == [8, 7, 5] and (m >= 0).all()


def test_matrix_is_hypergeometric():
    cell = [shard.communication_matrix([6, 6], [6, 6], s)[0, 0] for s in range(3000)]
    assert abs(np.mean(cell) - 3) < 0.08 and abs(np.var(cell) - 36 * 36 / (144 * 11)) < 0.08


def test_draws_follow_the_law():
    rng = np.random.Generator(np.random.PCG64(5))
    good, bad, draws = 9, 14, 11
    seen = Counter(shard.hypergeometric(rng, good, bad, draws) for _ in range(20_000))
    total = math.comb(good + bad, draws)
    law = {k: math.comb(good, k) * math.comb(bad, draws - k) / total for k in range(good + 1)}
    assert set(seen) <= {k for k, p in law.items() if p} and sum((seen[k] - 20_000 * p) ** 2 / (20_000 * p) for k, p in law.items() if 20_000 * p > 5) < 30
    assert shard.hypergeometric(rng, 5, 0, 3) == 3 and shard.hypergeometric(rng, 0, 5, 3) == 0 and shard.hypergeometric(rng, 4, 4, 8) == 4


@pytest.mark.parametrize("good,bad,draws", [(3 * 10**9, 10**10, 50_000), (10**12, 10**9, 10**6)])
def test_draws_of_very_many_rows(good, bad, draws):
    rng = np.random.Generator(np.random.PCG64(6))
    x = np.array([shard.hypergeometric(rng, good, bad, draws) for _ in range(2000)])
    p = good / (good + bad)
    sd = math.sqrt(draws * p * (1 - p))
    assert abs(x.mean() - draws * p) < 5 * sd / math.sqrt(2000) and abs(x.std() / sd - 1) < 0.08


def placed(df, shards=16, **options):
    return shard.shard(df, shards, **options).select("doc_id", "shard", "slot").collect()


@pytest.mark.parametrize("group_rows", [20, 50_000])
def test_shards_are_even_gapless_and_complete(spark, group_rows):
    rows = placed(data.frame(spark, data.documents()), group_rows=group_rows)
    sizes = Counter(r.shard for r in rows)
    assert sorted(r.doc_id for r in rows) == list(range(len(rows)))
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_sharding_reruns_agree_and_follow_the_seed(spark):
    df = data.frame(spark, data.documents())
    assert sorted(placed(df)) == sorted(placed(df.repartition(3))) != sorted(placed(df, seed=8))


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_sharding_edge_tables(spark, kind):
    df = data.edge_tables(spark)[kind]
    rows = placed(df, 4)
    assert len(rows) == df.count()
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(4))


def test_op7_columns(spark):
    rows = {r.doc_id: r for r in op7_hypergeometric_sharding(spark, f"{data.DATA}/sf0.001").collect()}
    for d, text, *_ in data.documents():
        assert rows[d].size == len(text.encode()) + 1 and rows[d].text_crc32 == zlib.crc32(text.encode()) and rows[d].law == "rows"


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets_are_shares_with_caps(sizes):
    weights = [i % 3 + 1 for i in range(len(sizes))]
    got = mix.targets(sizes, weights)
    assert all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes))
    assert abs(sum(got) - sum(sizes)) < 1e-6 * (1 + sum(sizes))
    free = [t / w for t, w, s in zip(got, weights, sizes) if t < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * (1 + max(free))


def test_splitting_tree_keeps_quotas():
    t = mix.splitting_tree([5, 0, 17, 3], 6, 2)
    assert t.sum(axis=0).tolist() == [5, 0, 17, 3] and t.sum(axis=1).max() - t.sum(axis=1).min() <= 1


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 8, 37, 1000):
        df = spark.range(n).select(*[mix.permuted(F.col("id"), F.lit(n).cast("long"), k, 7).alias(f"p{k}") for k in (1, 2)])
        rows = df.collect()
        assert all(sorted(r[k] for r in rows) == list(range(n)) for k in (0, 1))
    assert [r[0] for r in rows] != [r[1] for r in rows] and sum(abs(r[0] - i) for i, r in enumerate(rows)) > 1000 * 200


def brute_targets(sizes, weights, most=3):
    """By exact bisection of the common level."""
    total, low, high = sum(sizes), Fraction(0), Fraction(most * sum(sizes))
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(w * level, most * s) for w, s in zip(weights, sizes)) < total else (low, level)
    return [float(min(w * high, most * s)) for w, s in zip(weights, sizes)]


def mixed(df, **options):
    return [r.asDict(True) for r in mix.mix(df, **options).collect()]


def hold(rows, most=3):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] == sum(p["n_words"] for p in r["pieces"]) <= most * r["size"]
        for e in range(most):
            parts = sorted((p["from_word"], p["n_words"]) for p in r["pieces"] if p["epoch"] == e)
            at = 0
            for low, n in parts:
                assert low == at
                at += n
            assert at <= r["size"]
    for rs in by.values():
        assert rs[0]["source_size"] == sum(r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 1


@pytest.mark.parametrize("block_words", [50, 4096])
def test_mix_takes_exact_targets(spark, block_words):
    rows = mixed(data.frame(spark, data.documents()), block_words=block_words)
    hold(rows)
    places = [(p["shard"], p["place"]) for r in rows for p in r["pieces"]]
    for s in {s for s, _ in places}:
        used = sorted({p for t, p in places if t == s})
        assert used == list(range(len(used)))  # blocks of a shard are disjoint and gapless
    words = Counter()
    for r in rows:
        for p in r["pieces"]:
            words[p["shard"], p["place"]] += p["n_words"]
    assert max(words.values()) <= block_words


def test_mix_reruns_agree(spark):
    df = data.frame(spark, data.documents())
    key = lambda rows: sorted((r["doc_id"], str(r["pieces"])) for r in rows)
    assert key(mixed(df)) == key(mixed(df.repartition(5)))


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_mix_edge_tables(spark, kind):
    df = data.edge_tables(spark)[kind]
    rows = mixed(df)
    assert len(rows) == df.count()
    hold(rows)


def test_op10_against_brute_targets(spark):
    rows = op10_source_mixing(spark, f"{data.DATA}/sf0.001").collect()
    docs = {d: (t, s) for d, t, _, s, _ in data.documents()}
    sizes = Counter()
    for t, s in docs.values():
        sizes[s] += len(t.split())
    names = sorted(sizes)
    want = dict(zip(names, brute_targets([sizes[n] for n in names], [i % 3 + 1 for i in range(len(names))])))
    taken = Counter()
    hold([{**r.asDict(True), "source": docs[r.doc_id][1]} for r in rows])
    for r in rows:
        t, s = docs[r.doc_id]
        assert r.size == len(t.split()) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        taken[s] += r.taken
    assert all(abs(taken[n] - want[n]) <= 1 for n in names)
