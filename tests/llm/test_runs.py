"""Periodic runs against the definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from hazardspark.llm import queries, runs
from tests.llm.data import clashing, documents, edge_tables, frame

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_definition(words, min_length=6, min_exponent=4):
    """All (start, length, period), by trying every period at every place."""
    out, n = set(), len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(words[j] == words[j + p] for j in range(start, start + length - p)) for p in range(1, q))
            if length >= max(min_length, min_exponent * q) and not smaller:
                out.add((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def by_arrays(texts, **options):
    """The same of texts of letters laid end to end."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = np.array([ord(c) for t in texts for c in t], dtype=np.int64)
    first, end, period = runs.runs(codes, starts, **options)
    out = [[] for _ in texts]
    for f, e, p in zip(first, end, period):
        d = int(np.searchsorted(starts, f, side="right")) - 1
        out[d].append((int(f - starts[d]), int(e - f), int(p)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_random_words(seed):
    r = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(12)]
    texts += [("".join(r.choice(letters) for _ in range(r.randrange(1, 9))) * 12)[: r.randrange(60)] for _ in range(8)] + ["", "a", "a" * 30, "ab" * 15, "aab" * 9 + "a", texts[0], texts[0] * 4]
    for options in ({}, {"min_length": 1, "min_exponent": 2}, {"min_length": 8, "min_exponent": 3}):
        assert by_arrays(texts, **options) == [by_definition(t, **({"min_length": 6, "min_exponent": 4} | options)) for t in texts]


def test_fibonacci_and_long_periods():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    deep = "".join(random.Random(3).choice("abcd") for _ in range(97))
    texts = [b, deep * 5, "x" + deep * 4 + "y" + deep * 4, "z" * 1000 + deep * 6 + "z" * 1000]
    for options in ({}, {"min_length": 1, "min_exponent": 2}):
        assert by_arrays(texts, **options) == [by_definition(t, **({"min_length": 6, "min_exponent": 4} | options)) for t in texts]
    with pytest.raises(ValueError):
        by_arrays(texts, min_exponent=1)


def test_common_prefixes_and_next_smaller():
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(50)), "ab" * 20, "b"]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    s = runs.Suffixes(np.array([ord(c) for t in texts for c in t], dtype=np.int64), starts)
    for d, t in enumerate(texts[:2]):
        for _ in range(200):
            i, j = r.sample(range(len(t)), 2)
            want = next((k for k in range(len(t)) if max(i, j) + k >= len(t) or t[i + k] != t[j + k]), 0)
            assert s.common(np.array([starts[d] + i]), np.array([starts[d] + j]))[0] == want
    after = s.next_smaller(s.rank)
    for d, t in enumerate(texts):
        suffixes = [t[i:] for i in range(len(t))]
        assert [int(x - starts[d]) for x in after[starts[d] : starts[d + 1]]] == [next((j for j in range(i + 1, len(t)) if suffixes[j] < suffixes[i]), len(t)) for i in range(len(t))]


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = by_definition(words)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    start, length, period = best or (None, None, None)
    lines = "".join(f"{s},{n_},{p}\n" for s, n_, p in found)
    return (doc_id, len(found), start, length, period, best and 1000 * length // period, digest(lines), digest(collapsed(words, found)))


def test_query_matches_definition(spark):
    rows = [r for r in documents(n=200) if len(r[1] or "") < 8000]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(documents())
    for r in rows:
        assert got[r[0]] == expected(r[0], r[1])
    assert sum(r[1] > 0 for r in got.values()) >= len(got) / 20


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_edges(spark, name):
    df = edge_tables(spark)[name]
    out = runs.find_runs(df.withColumnRenamed("text", "body"), text="body", block_words=50)
    assert set(df.columns) - {"text"} <= set(out.columns)
    rows = out.collect()
    key = lambda r: (str(r["doc_id"]), r["n_chars"] or 0, str(r["lang"]))
    assert sorted(map(key, rows)) == sorted(map(key, df.collect()))
    for r in rows:
        if r["doc_id"] == 7:
            assert [tuple(x) for x in r["runs"]] == [(0, 60_000, 1)] and r["collapsed"] == "wörd"
        elif r["doc_id"] in (1, 2, 3):
            assert r["runs"] == [] and r["collapsed"] == ""
    assert out.select("runs").schema["runs"].dataType.simpleString() == "array<struct<start:bigint,length:bigint,period:bigint>>"


def test_operator_keeps_spans_and_texts(spark):
    words = "x a b a b a b a b y".split()
    df = clashing(frame(spark, [(1, "\t" + "  ".join(words), "en", "s", 1), (1, None, None, None, None)]))
    got = {r["lang"]: r for r in runs.find_runs(df).collect()}
    assert [tuple(x) for x in got["en"]["runs"]] == [(1, 8, 2)] and got["en"]["collapsed"] == "x a b y"
    assert got[None]["runs"] == [] and got["en"]["slot"] == "extra"
