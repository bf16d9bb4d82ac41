import random

import pytest
from pyspark.sql import functions as F

from hazardspark.llm import linededup


@pytest.mark.parametrize("long_line", [False, True])
def test_passages_of_short_lines_go_whole(spark, long_line):
    rng, rows, want = random.Random(8), [], {}
    line = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    own = lambda: [line(rng.randrange(4, 14)) for _ in range(rng.randrange(1, 9))]
    for lines in range(4, 11):
        for size in range(8, 14):
            passage = [line(size) for _ in range(lines)]
            if long_line:
                passage[0], passage[2] = line(40), line(3)
            for copy in range(3):
                a, b = own(), own()
                rows.append((len(rows), "\n".join([*a, *passage, *b])))
                want[rows[-1][0]] = "\n".join([*a, *passage, *b] if not copy else [*a, *b])
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=linededup.PASSAGE_WORDS).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.removed_lines == r.n_lines - len(want[r.doc_id].split("\n")) for r in got)


def test_runs_against_brute_force(spark):
    rng, rows = random.Random(2), []
    for _ in range(300):
        words = [rng.randrange(0, 20) if rng.random() < 0.7 else 0 for _ in range(rng.randrange(1, 60))]
        want = set()
        for i in range(len(words)):
            forward = [j for j in range(i + 2, len(words) + 1) if sum(words[i:j]) >= 16 > sum(words[i : j - 1])]
            backward = [j for j in range(i) if sum(words[j : i + 1]) >= 16 > sum(words[j + 1 : i + 1])]
            want |= {(i, j - i) for j in forward if words[i]} | {(j, i + 1 - j) for j in backward if words[i]}
        rows.append((words, sorted(want)))
    steps, runs = linededup.line_runs(16)
    df = spark.createDataFrame(rows, "__w array<int>, want array<struct<low: int, size: int>>")
    for name, column in steps:
        df = df.withColumn(name, column)
    assert df.where(F.array_sort(runs) != F.col("want")).count() == 0
