"""Phrases in documents against a search of every place."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from hazardspark.llm import phrases, queries
from tests.llm.data import clashing, documents, edge_tables, frame

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def hits(text, items, width=10, slop=0):
    """Of a document: number of words, and per item the places that its windows cover."""
    w, out = words_of(text), {}
    for item, phrase in items:
        v = words_of(phrase)
        size = min(len(v), width)
        for k in range(len(v) - size + 1 if v else 0):
            for s in range(-slop, len(w) + slop):
                near = all(any(0 <= p < len(w) and w[p] == v[k + i] for p in range(s + i - slop, s + i + slop + 1)) for i in range(size))
                if near:
                    out.setdefault("" if item is None else str(item), set()).update(range(max(s - slop, 0), min(s + size + slop, len(w))))
    return len(w), out


def by_operator(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    given = spark.createDataFrame(items, "item_id int, text string")
    index = phrases.build_index(docs, axis_bytes=options.pop("axis_bytes", 200))
    out = [{} for _ in texts]
    rows = phrases.matches(index, given, **options).collect()
    for r in rows:
        out[r["doc_id"]].setdefault(r["item_id"], []).append((r["start"], r["length"]))
    return out, rows


def stretches(places):
    places, out = sorted(places), []
    for p in places:
        if out and out[-1][0] + out[-1][1] == p:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((p, 1))
    return out


def made(seed, letters, n=25):
    r = random.Random(seed)
    word = lambda: r.choice(letters)
    texts = [" ".join(word() for _ in range(r.randrange(30))) for _ in range(n)] + ["", None, "a", "a b " * 40]
    items = [(i % 5, " ".join(word() for _ in range(r.randrange(1, 9)))) for i in range(8)] + [(9, ""), (10, None), (None, "a b a"), (11, "q"), (9, "a")]
    return texts, items


@pytest.mark.parametrize("seed,width,slop,block_words", [(1, 3, 0, 1_000_000), (2, 4, 0, 8), (3, 1, 0, 1_000_000), (4, 3, 1, 1_000_000), (5, 2, 2, 9), (6, 10, 0, 1_000_000)])
def test_matches_at_every_place(spark, seed, width, slop, block_words):
    texts, items = made(seed, "a b c d".split())
    got, _ = by_operator(spark, texts, items, width=width, slop=slop, block_words=block_words)
    for text, found in zip(texts, got):
        assert {k: sorted(v) for k, v in found.items()} == {k: stretches(v) for k, v in hits(text, items, width, slop)[1].items()}


def test_contamination_and_blocks(spark):
    texts, items = made(7, "a b c".split(), 40)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    given = spark.createDataFrame(items, "item_id int, text string")
    for options in ({}, {"block_words": 5}, {"axis_bytes": 1}):
        rows = phrases.contamination(docs, given, width=3, **options).collect()
        assert len(rows) == len(texts)
        for r in rows:
            n, found = hits(texts[r["doc_id"]], items, 3)
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, len(set().union(*found.values())), sorted(found), bool(found))


def test_few_candidates_at_a_time():
    texts, _ = made(8, "ab", 30)
    texts = pa.array([t or "" for t in texts], pa.string())
    own = pa.StructArray.from_arrays([pa.array(range(len(texts)))], ["doc_id"])
    _, begins, words, counts, places = phrases.axis_of(own, texts)
    axis = phrases.Axis(begins[0].values.to_numpy().astype(np.int64), words[0].values, counts[0].values.to_numpy(), places[0].as_py())
    at = {w: i for i, w in enumerate(axis.words.to_pylist())}
    windows = np.array([[at["a"], at["b"], at["a"]], [at["b"], at["b"], at["b"]], [at["a"], -1, at["a"]]])
    for slop in (0, 1):
        all_, few = ({tuple(map(int, r)) for part in axis.find(windows, slop, most) for r in zip(*part)} for most in (1 << 20, 5))
        assert all_ == few and {w for w, _, _ in all_} == {0, 1}
        assert max(len(part[0]) for part in axis.find(windows, slop, 5)) <= 15


def test_words_and_folding():
    texts = ["Ünd x É_A-b\x7f9[Z`{", "", "日本 ABC\tdef", "\x00a\x1fb", "ß"]
    words, of = phrases.split_folded(pa.array(texts))
    got = [[] for _ in texts]
    for w, i in zip(words.to_pylist(), of):
        got[i].append(w)
    assert got == [words_of(t) for t in texts]
    words, of = phrases.split_folded(pa.array(["x", "Y z", "q"]).slice(1))
    assert words.to_pylist() == ["y", "z", "q"] and list(of) == [0, 0, 1]


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_edges(spark, name):
    df = edge_tables(spark)[name]
    items = spark.createDataFrame([(1, "ONE"), (2, "words of a line that is long enough to be a chunk"), (3, None), (None, "def")], "item_id long, text string")
    out = phrases.contamination(df, items)
    assert set(df.columns) - {"text"} <= set(out.columns)
    by_text = {(r["doc_id"], r["lang"], r["n_chars"]): hits(r["text"], [(x["item_id"], x["text"]) for x in items.collect()]) for r in df.collect() if r["doc_id"] not in (7, 8)}
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        if r["doc_id"] in (7, 8):
            assert not r["contaminated"] and r["n_words"] == {7: 60_000, 8: 20_000}[r["doc_id"]]
        else:
            n, found = by_text[r["doc_id"], r["lang"], r["n_chars"]]
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(set().union(*found.values())), sorted(found))
    assert phrases.contamination(df, items.limit(0)).where("contaminated").count() == 0


def test_repeated_index_rows_and_clashing_names(spark):
    df = clashing(frame(spark, [(1, "a b c", "en", "s", 1), (1, "a b c", "en", "s", 1)]))
    rows = phrases.matches(phrases.build_index(df), spark.createDataFrame([(1, "b c")], "item_id int, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["start"], r["length"], r["slot"]) for r in rows] == [(1, "1", 1, 2, "extra")] * 2
    with pytest.raises(ValueError):
        phrases.contamination(df, df.select(df.doc_id.alias("item_id"), "text"), width=0)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.op11_phrase_decontamination(spark, SF)
    want = con.sql(queries.ORACLE_SQL["op11_phrase_decontamination"])
    rows = sorted(map(tuple, got.select(sorted(got.columns)).collect()))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows == sorted(want.select(*sorted(want.columns)).fetchall())
    assert any(r["contaminated"] for r in got.collect())


def test_planted_passages_are_found(spark):
    items = [(r[0], " ".join((r[1] or "").split()[:30])) for r in documents(n=20) if len((r[1] or "").split()) > 30]
    rows = [(100 + i, f"before. {text.translate({c + 32: c for c in range(65, 91)})} after", "en", "s", 0) for i, text in items] + [(999, "nothing of it", "en", "s", 0)]
    found = phrases.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in found:
        assert r["contaminated"] == (r["doc_id"] != 999) and (r["doc_id"] == 999 or str(r["doc_id"] - 100) in r["items"])
    assert hashlib.sha256(b"").hexdigest() == queries.op11_phrase_decontamination(spark, SF).where("NOT contaminated").first()["items_sha256"]
