import pytest
from pyspark.sql import functions as F

from hazardspark.llm import linededup
from tests.llm import data

MASK = (1 << 64) - 1


def signed(x):
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def brute(spark, rows, window=2, one_in=4, long_words=16):
    """New texts of (doc_id, text) rows: chunks by the stated rule, removed where their text occurs earlier."""
    lines = sorted({x for _, t in rows for x in (t or "").split("\n")})
    hashed = {r.s: r.h for r in spark.createDataFrame([(x,) for x in lines], "s string").select("s", F.xxhash64("s").alias("h")).collect()}
    words = lambda s: len([w for w in s.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])
    chunks, first = [], {}
    for doc, text in rows:
        ls, at, no = (text or "").split("\n"), 0, 0
        for i in range(len(ls)):
            roll = hashed[ls[i]] & MASK
            for k in range(1, min(window, i + 1)):
                h = hashed[ls[i - k]] & MASK
                roll ^= (h << k | h >> (64 - k)) & MASK
            if i == len(ls) - 1 or words(ls[i]) >= long_words or words(ls[i + 1]) >= long_words or signed(roll) % one_in == 0:
                part = ls[at : i + 1]
                n = sum(map(words, part))
                if (len(part) > 1 and n) or n >= long_words:
                    place = (doc is not None, doc if doc is not None else 0, text or "", no)
                    chunks.append((doc, text, at, i + 1, tuple(part), place))
                    first[tuple(part)] = min(first.get(tuple(part), place), place)
                at, no = i + 1, no + 1
    gone = {}
    for doc, text, a, b, part, place in chunks:
        if place != first[part]:
            gone.setdefault((doc, text), set()).update(range(a, b))
    return [(doc, None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get((doc, text), ()))) for doc, text in rows]


def result(df):
    return sorted(((r.doc_id, r.text) for r in linededup.dedup_lines(df).select("doc_id", "text").collect()), key=str)


def test_documents_against_brute_force(spark):
    rows = data.documents("sf0.01", 500)
    assert result(data.frame(spark, rows)) == sorted(brute(spark, [(r[0], r[1]) for r in rows]), key=str)


def unambiguous(rows):
    # which of two rows without doc_id comes first is settled by a hash, so only one of them takes part here
    return [r for r in rows if r[0] is not None or "two" in r[1]]


@pytest.mark.parametrize("clash", [False, True])
def test_edge_tables(spark, clash):
    rows = unambiguous(data.odd_rows())
    df = data.frame(spark, rows)
    df = data.clashing(df) if clash else df
    assert result(df) == sorted(brute(spark, [(r[0], r[1]) for r in rows]), key=str)
    assert len(linededup.dedup_lines(df).columns) == len(set(df.columns) | {"n_lines", "removed_lines", "removed_chunks"})


def test_empty_table(spark):
    assert result(data.edge_tables(spark)["empty"]) == []


def test_passages_go_where_they_repeat_and_clean_texts_stay(spark):
    passage = "\n".join(" ".join(f"p{i}q{j}" for j in range(20)) for i in range(3))
    own = lambda k: "\n".join(f"d{k} line {i} is its own" for i in range(8))
    rows = [(k, own(k) if k % 2 else f"{own(k)}\n{passage}\n{own(-k - 1)}") for k in range(40)]
    got = dict(result(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [k for k, t in got.items() if passage in t] == [0]
    assert all(got[k] == (t if k % 2 or k == 0 else f"{own(k)}\n{own(-k - 1)}") for k, t in rows)


def test_insertions_move_no_far_boundary(spark):
    body = [f"short line {i} of a text" for i in range(200)]
    rows = [(1, "\n".join(body)), (2, "\n".join(["one more line", *body[:90], "and another", *body[90:]]))]
    got = dict(result(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1] == rows[0][1] and len(got[2].split("\n")) < 45


def test_hash_twins_are_compared_by_bytes(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(linededup.F, "xxhash64", lambda *c: real(*c) if len(c) != 1 else F.lit(4).cast("long"))
    rows = [(1, "a b\nc d"), (2, "e f\ng h"), (3, "a b\nc d")]
    got = dict(result(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1] == rows[0][1] and got[2] == rows[1][1]
