from collections import Counter

import pytest

import corpus_pipeline
from hazardspark.llm.common import materialize
from tests.llm import data
from tests.llm.test_similar import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, df):
    out = [df]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], None)))
    return out


def test_stages_keep_columns_and_take_effect(spark):
    steps = stages(spark, data.frame(spark, data.documents("sf0.01", 600)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "packing"]
    assert all(s.columns == COLUMNS for s in steps[:-1])
    texts = [[tuple(r) for r in s.collect()] for s in steps[:-1]]
    kept = {r[0]: r for r in texts[1]}
    assert len(kept) < 600 and all(kept[r[0]] == r for r in texts[0] if r[0] in kept)
    assert all(r[4] == len(r[1]) and set(r[1].split("\n")) <= set(kept[r[0]][1].split("\n")) for r in texts[2])
    groups = brute([r[:2] for r in texts[2]])  # by five-word shingles of similarity 0.8
    assert sorted(r[0] for r in texts[3]) == sorted(d for d, first in groups.items() if d == first)
    words, taken = Counter(), Counter()
    for r in texts[3]:
        words[r[3]] += len(r[1].split())
    for r in texts[4]:
        taken[r[3]] += len(r[1].split())
    names = sorted(words)
    want = dict(zip(names, corpus_pipeline.mix.targets([words[n] for n in names], [i % 3 + 1 for i in range(len(names))])))
    assert all(abs(taken[n] - want[n]) < 2500 for n in names) and abs(sum(taken.values()) - sum(words.values())) < 5000
    assert max(Counter(r[0] for r in texts[4]).values()) <= 3
    pieces = steps[-1].collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r[0] for r in texts[4])


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_pipeline_edge_tables(spark, kind):
    df = data.edge_tables(spark)[kind]
    for _, stage in corpus_pipeline.STAGES:  # each stage alone takes any table
        stage(spark, df, None).collect()
    for s in stages(spark, df)[:-1]:
        assert s.columns == df.columns
        if kind == "clashing":  # other columns keep their values, whatever their names
            assert all(r[c] == "extra" for r in s.collect() for c in df.columns[5:])


def test_repeated_rows_leave_one_document(spark):
    rows = [(7, "some words here", "en", "a", 15)] * 3 + [(8, "some words here", "en", "a", 15), (None, "other", None, None, 5), (None, "more", None, None, 4)]
    got = sorted((tuple(r)[:2] for r in corpus_pipeline.near_dedup(spark, data.frame(spark, rows), None).collect()), key=str)
    assert got == [(7, "some words here"), (None, "more"), (None, "other")]


def test_mixing_repeated_rows_stays_near_target(spark):
    rows = [(1, "a b c d e f g h i j", "en", "s1", 19)] * 30 + [(k, "x y z u v", "en", "s2", 9) for k in range(10, 200)]
    got = corpus_pipeline.source_mixing(spark, data.frame(spark, rows), None).collect()
    words = Counter()
    for r in got:
        words[r.source] += len(r.text.split())
    want = dict(zip(["s1", "s2"], corpus_pipeline.mix.targets([300, 950], [1, 2])))
    assert all(abs(words[s] - want[s]) <= 10 for s in want)
