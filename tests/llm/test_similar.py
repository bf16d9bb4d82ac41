import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from hazardspark.llm import ring, shingles, simhash
from tests.llm import data


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def planted():
    """Texts of their own, and edits of some at similarities on both sides of 0.8."""
    rng, rows = random.Random(4), []
    for base in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((6, 30, 80, 200)))]
        rows += [" ".join(edited(rng, words, k)) for k in (0, 0, 1, 2, 3, 5)]
    words = [f"v{i}" for i in range(150)]
    rows += [" ".join(edited(rng, words, rng.randrange(4))) for _ in range(120)]
    return list(enumerate([*rows, "", "  ", "one two", "One two"]))


def shingled(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingled(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("bucket", [1, 16, 10_000])
def test_groups_against_brute_force(spark, bucket):
    rows = planted()
    want = brute(rows)
    assert len(set(want.values())) < len(rows) - 150
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df, width=5, percent=80, bucket_pairs=bucket).collect()} == want


def test_stage_drops_edited_copies_of_documents(spark):
    rng, docs = random.Random(5), [r for r in data.documents("sf0.01", 400) if len(r[1].split()) >= 50]
    copies = [(10_000 + d, " ".join(edited(rng, t.split(), 1 + len(t.split()) // 100)), *rest) for d, t, *rest in docs[::4]]
    rows = docs + copies
    want = brute([(r[0], r[1]) for r in rows])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, data.frame(spark, rows), None).collect()}
    assert kept == {d for d, c in want.items() if d == c} and sum(r[0] in kept for r in copies) < len(copies) / 10


def test_fingerprints_of_similar_sets_stay_within_the_radius():
    rng = random.Random(6)
    far = []
    for _ in range(3000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((9, 12, 40, 150)))]
        a, b = (shingles.shingles(pa.array([" ".join(x)]))[0] for x in (words, edited(rng, words, 1) if len(words) > 30 else [*words, "x"]))
        if 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)):
            far.append((shingles.set_print(a) ^ shingles.set_print(b)) & (1 << 64) - 1)
    assert len(far) > 1000 and max(x.bit_count() for x in far) <= shingles.RADIUS


def test_chains_hold_for_all_pairs_within_the_radius(spark):
    rng = random.Random(7)
    rows = [(ring.signed(sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 50)))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "diff long")
    for radius, segments in ((2, 5), (28, 8)):
        got = {r.diff for r in df.where(ring.within(df.diff, radius, segments)).collect()}
        assert got == {d for d, in rows if (d & (1 << 64) - 1).bit_count() <= radius}


def test_shingles_of_texts():
    assert [len(s) for s in shingles.shingles(pa.array(["", "a b", ""]))] == [0, 1, 0]
    texts = ["", " a ", "a b c d", "A b c d e", "x y a b c d e f a b c d e", "a b c d e a b c d e a b c d e"]
    got = shingles.shingles(pa.array(texts))
    assert [len(s) for s in got] == [len(shingled(t)) for t in texts] and all((s[:-1] < s[1:]).all() for s in got)
    assert got[3][0] in got[4] and set(got[4].tolist()).isdisjoint(got[2].tolist())


def test_pruning_by_fingerprints_loses_no_group_of_documents(spark):
    rows = [(r[0], r[1]) for r in data.documents("sf0.01", 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = [{r.doc_id: r.component_id for r in simhash.near_duplicates(df, width=5, percent=80, prune=prune).collect()} for prune in (True, False)]
    assert groups[0] == groups[1] and len(set(groups[0].values())) < len(rows)


def test_sketches_turn_a_bit_at_most_for_each_differing_element():
    rng = np.random.default_rng(4)
    for n in (1, 40, 700, 5000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate([a[: n - n // 5], rng.integers(-(1 << 62), 1 << 62, n // 5)]))
        turned = sum(bin(int(x) & (2**64 - 1)).count("1") for x in shingles.odd_sketch(a) ^ shingles.odd_sketch(b))
        assert turned <= len(np.setxor1d(a, b)) and (turned - len(np.setxor1d(a, b))) % 2 == 0


def test_edited_copies_far_from_each_other_make_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base, rows = [f"w{k}" for k in range(500)], []
    for d in range(60):
        words = list(base)
        for k in rng.choice(500, 12, replace=False):
            words[k] = f"e{d}x{k}"
        rows.append((d, " ".join(words)))
    rows += [(100, rows[0][1] + " more"), (101, rows[1][1] + " other")]
    made, verified = [], shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, *rest: made.append(pairs.count()) or verified(pairs, *rest))
    docs, roots = shingles.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(made) < 200  # all pairs of the group would be 1,891
    root = {r.node: r.root for r in roots.collect()}
    of = {r.doc_id: root.get(r.node, r.node) for r in docs.collect()}
    assert of[0] == of[100] and of[1] == of[101] and len(set(of.values())) == 60
