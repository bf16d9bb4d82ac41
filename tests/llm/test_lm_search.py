import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hazardspark.llm import lm, search
from tests.llm import data


def small_model(seed=0, units=40, end=39, window=8):
    rng = np.random.default_rng(seed)
    texts = [np.append(rng.integers(0, end, 60), end) for _ in range(20)]
    counts = np.bincount(np.concatenate(texts), minlength=units)
    return lm.train(texts, units, end, counts, classes=12, known=20, dim=4, window=window, steps=20), texts


def test_windows_score_each_unit_once_and_causally():
    model, texts = small_model()
    kinds, whole = model.log_probs(texts[:3] + [np.array([39])])
    assert [len(x) for x in whole] == [61, 61, 61, 1]
    changed = texts[0].copy()
    changed[40] = (changed[40] + 1) % 39
    other = model.log_probs([changed])[1][0]
    assert np.allclose(other[:40], whole[0][:40], atol=1e-5) and abs(other[41] - whole[0][41]) > 0
    one_by_one = np.concatenate([x for t in texts[:3] for x in model.log_probs([t])[1]])
    assert np.allclose(one_by_one, np.concatenate(whole[:3]), atol=1e-4)


def test_next_unit_probabilities_sum_to_one():
    model, texts = small_model()
    past = texts[0][:10]
    every = [np.append(past, u) for u in range(40)]
    assert math.isclose(sum(math.exp(x[-1]) for x in model.log_probs(every)[1]), 1, abs_tol=1e-4)


def test_training_follows_the_gradient():
    rng = np.random.default_rng(1)
    texts = [np.append(np.tile(rng.permutation(6), 20), 39) for _ in range(30)]  # each text repeats its own order
    counts = np.bincount(np.concatenate(texts), minlength=40)
    nll = [-np.concatenate(lm.train(texts, 40, 39, counts, classes=20, known=20, dim=8, window=16, steps=s).log_probs(texts)[1]).mean() for s in (1, 400)]
    assert nll[1] < nll[0] - 0.3


def test_scores_against_brute_force_counts(spark):
    rows = data.documents("sf0.01", 500)
    got = {r.doc_id: r for r in lm.score(data.frame(spark, rows), common=300, steps=60).collect()}
    again = {r.doc_id: r for r in lm.score(data.frame(spark, rows), steps=60).collect()}
    split = {d: ["".join(c.lower() if c.isascii() else c for c in w) if w else w for w in [*t.split(), None]] for d, t, *_ in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in split}
    counts = Counter(w for d, ws in split.items() if not held[d] for w in ws)
    n, v = counts.total(), len(counts)
    for d, ws in split.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d], len(ws), n)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isclose(r.score, again[d].score, rel_tol=1e-6)  # however many counts are broadcast
    assert sum(r.score for r in got.values() if not r.held_out) > sum(r.base_score for r in got.values() if not r.held_out)


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_lm_edge_tables(spark, kind):
    df = data.edge_tables(spark)[kind]
    got = lm.score(df, steps=5).collect()
    assert len(got) == df.count() and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    if got:
        empty = [r for r in got if r.doc_id in (1, 2, 3)]
        assert all(r.n_tokens == 1 for r in empty)


def brute_top(rows, queries, k):
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").split()
    docs = [(d, Counter(lower(t))) for d, t in rows]
    n, average = len(docs), sum(c.total() for _, c in docs) / max(1, len(docs))
    df = Counter(w for _, c in docs for w in c)
    out = []
    for q, t in queries:
        scored = []
        for d, c in docs:
            s = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / average)) for w in sorted(set(lower(t))) if w in c]
            if s:
                scored.append((-round(sum(s), 6), d is None, d or 0, d))
        out += [(q, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 20_000, "block_queries": 3, "k": 4}, {"shard_bytes": 50_000, "block_terms": 100}])
def test_search_is_exact(spark, options):
    rows = data.documents("sf0.01", 600)
    df = data.frame(spark, rows)
    got = [tuple(r) for r in search.top_k(df, df.where("doc_id % 50 = 0"), **options).collect()]
    want = brute_top([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 50 == 0], options.get("k", 10))
    assert [x[:3] for x in sorted(got, key=str)] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(sorted(got, key=str), want))


def searched(texts, asked, k, block_docs):
    """Best of the texts for queries of (word, weight), and the share of blocks that were scored."""
    row = search.shard_of(pa.array(range(len(texts))), pa.array(texts))
    rows = [{"query_id": i, "words": [w for w, _ in q], "weights": [x for _, x in q]} for i, q in enumerate(asked)]
    block, best = search._block(rows), search.Best(len(asked), k)
    shard = search.Shard(row, block, 50.0, block_docs)
    shard.search(best)
    return best.score, best.doc, shard.scored / (shard.blocks * len(asked))


def test_blocks_are_pruned_and_results_stay():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, 50) % 300) for _ in range(500)]
    asked = [[(f"w{i}", x) for i, x in zip(t, np.linspace(1, 2, len(t)))] for t in ([250], [7, 99, 180], [1, 2, 3, 40, 41, 42], [260, 261, 262, 1])]
    small, whole = (searched(texts, asked, 5, n) for n in (8, 1000))
    assert np.allclose(small[0], whole[0]) and (small[1] == whole[1]).all()
    assert small[2] < 0.8 and whole[2] == 1


def test_thresholds_pass_from_shard_to_shard():
    asked = search._block([{"query_id": 1, "words": ["a", "b"], "weights": [1.0, 2.0]}])
    best, scored = search.Best(1, 2), []
    for texts in (["a b", "a b b", "b"] * 20, ["a x y z"] * 64):
        shard = search.Shard(search.shard_of(pa.array(range(len(texts))), pa.array(texts)), asked, 2.0, 4)
        shard.search(best)
        scored.append(shard.scored)
    assert scored[1] <= 1 < scored[0]  # after the first, no block of the second can reach the best two


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_search_edge_tables(spark, kind):
    df = data.edge_tables(spark)[kind]
    rows = [(r.doc_id, r.text) for r in df.collect()]
    queries = df.where("doc_id IN (1, 2, 3, 5, 9)")
    got = sorted((tuple(r)[:3] for r in search.top_k(df, queries).collect()), key=str)
    want = brute_top(rows, [(d, t) for d, t in rows if d in (1, 2, 3, 5, 9)], 10)
    assert got == [x[:3] for x in want]


MANY = """
import resource
import numpy as np, pyarrow as pa
from hazardspark.llm import search
rng = np.random.default_rng(1)
words = np.array([f"w{i}" for i in range(2000)])
def batches():
    for low in range(0, 1_000_000, 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + 10_000)), pa.array(words[rng.integers(0, 2000, 10_000) // rng.integers(1, 2000, 10_000)])], ["doc_id", "__text"])
asked = search.Queries(np.arange(1000), pa.array(words), np.ones(2000), np.repeat(np.arange(1000), 3) * 7 % 2000, np.arange(1, 1001) * 3)
begun = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
best, shards = search.Best(1000, 10), 0
for row in search._build(search.SHARD_BYTES)(batches()):
    search.Shard(row, asked, 1.0).search(best)
    shards += 1
print(shards, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - begun) // 1024)
"""


def test_a_million_short_texts_need_little_memory():
    import subprocess
    import sys
    from pathlib import Path

    out = subprocess.run([sys.executable, "-c", MANY], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=600, check=True).stdout.split()
    assert int(out[0]) >= 1_000_000 // search.SHARD_DOCS and int(out[1]) < 500
