"""The filter audit against a simulation of every order."""

import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from hazardspark.llm import audit, queries
from tests.llm.data import clashing, documents, edge_tables, frame

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """The letters that each (doc_id, text) fails."""
    out = []
    for i, text in rows:
        text = text or ""
        words = WORD.findall(text)
        found = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t in rows),
        }
        out.append({k for k, v in found.items() if v})
    return out


def simulated(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    of = fails([(i, t) for i, t, _ in rows])
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts, out = {}, {}
    for (i, _, source), f in zip(rows, of):
        parts.setdefault(source or "", []).append((i, f))
    for part, docs in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                total[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(letter in f for _, f in docs) - len(gone), sum(f == {letter} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in df.collect()}


def test_documents_match_simulation(spark):
    rows = documents(n=120)
    rows += [(900 + i, r[1], r[2], r[3], r[4]) for i, r in enumerate(rows[:7])] + [(901, rows[1][1], "en", "z", 1), (901, rows[1][1], "en", "z", 1)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 903, 2)] + [(2, 1, 0), (4, None, None), (None, 1, 1)]
    got = found(audit.audit_documents(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == simulated([(r[0], r[1], r[3]) for r in rows], labels)


@pytest.mark.parametrize("name", ["odd", "clashing", "empty"])
def test_edges(spark, name):
    df = edge_tables(spark)[name]
    labels = [(4, 1, 0), (5, 0, 1), (5, 1, 0)]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    got = found(audit.audit_documents(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == simulated(rows, labels) and len(got) == 600 * len({r[2] or "" for r in rows})


def test_other_filters_and_null_flags(spark):
    rows = spark.createDataFrame([("a", True, None, 2), ("a", True, True, 1), ("b", False, False, 5)], "part string, X boolean, Y boolean, n long")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in audit.audit(rows, "XY", ["n"]).collect()}
    assert got["a", "XY", 1] == (0, 3, 0, 2, 5) and got["a", "XY", 2] == (0, 0, 1, 0, 1) and got["a", "YX", 1] == (2, 1, 0, 0, 1)
    assert got["b", "YX", 2] == (5, 0, 0, 0, 0) and len(got) == 8
    with pytest.raises(ValueError):
        audit.audit(rows, ["X", "X"], ["n"])


def test_joint_failures_are_products(spark):
    rows = spark.createDataFrame([("a", i & 1 > 0, i & 2 > 0, i & 4 > 0, i + 1) for i in range(8)], "part string, X boolean, Y boolean, Z boolean, n long")
    joint = audit.joint_failures(rows, "XYZ", ["n"]).first()["n"]
    assert joint == [sum(i + 1 for i in range(8) if i & s == s) for s in range(8)]
    left = spark.createDataFrame([(joint,)], "j array<long>").select(audit.survivors(F.col("j"), 3)).first()[0]
    assert left == [sum(i + 1 for i in range(8) if not i & p) for p in range(8)]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.op12_filter_audit(spark, SF)
    want = con.sql(queries.ORACLE_SQL["op12_filter_audit"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(sorted(got.columns)).collect())) == sorted(want.select(*sorted(want.columns)).fetchall())


def test_no_plan_joins_on_copies_alone(spark):
    df = clashing(frame(spark, documents(n=5)))
    plan = audit.failures(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Window" not in plan
