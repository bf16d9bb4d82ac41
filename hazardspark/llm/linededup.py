"""Removal of line chunks that repeat across the corpus, with content-defined boundaries.

A text's lines are cut into chunks where a rolling hash (a cyclic polynomial over the hashes of the
last ``window`` lines) meets a mask, and on both sides of a line of ``long_words`` words or more, so a
boundary depends on a few lines only and an inserted line moves no boundary further away. Chunks of
several lines, and single long lines, that occur more than once are removed except where they occur
first; equal hashes only nominate chunks, and their bytes are compared before removal.

Boundaries may miss a passage of short lines, so with ``passage_words`` from each line with words the shortest run of lines of so many words
or more is taken too, forwards and backwards. Each line of a repeated passage of so many words lies in such a run
that is wholly in the passage, wherever it begins. Runs are nominated and compared like chunks.

Counting shuffles hashes, pre-aggregated; texts are shuffled of nominated chunks only, and once of
the documents. All joins are equi-joins whose many-row side Spark can split where one chunk is in very
many documents; nothing but hashes, positions and line texts of one row is ever in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import WORD_PATTERN, materialize, packed

KEY = ["__k1", "__k2"]
#: Least words of a repeated run of lines, of the query and the pipeline.
PASSAGE_WORDS = 32


def _chunks(text: str, window: int, one_in: int, long_words: int) -> tuple[list[tuple[str, Column]], Column]:
    """Columns to add one after another, and the array of (no, low, n, words, hash) of a row's chunks."""
    last = F.size("__lines") - 1
    index = F.sequence(F.lit(0), last)

    def rolling(i: Column) -> Column:
        out = F.element_at("__h", i + 1)
        for k in range(1, window):
            before = F.coalesce(F.try_element_at("__h", F.greatest(i + 1 - k, F.lit(1))), F.lit(0).cast("long"))
            turned = F.shiftleft(before, k).bitwiseOR(F.shiftrightunsigned(before, 64 - k))
            out = out.bitwiseXOR(F.when(i >= k, turned).otherwise(F.lit(0).cast("long")))
        return out

    def ends(i: Column) -> Column:
        around = (F.element_at("__w", i + 1) >= long_words) | (F.element_at("__w", i + 2) >= long_words)
        return F.when(i == last, True).otherwise(around | (F.pmod(rolling(i), F.lit(one_in)) == 0))

    def chunk(e: Column, j: Column) -> Column:
        low = F.when(j == 0, 0).otherwise(F.element_at("__ends", F.greatest(j, F.lit(1))) + 1)
        n = e - low + 1
        words = F.aggregate(F.slice("__w", low + 1, n), F.lit(0), lambda a, x: a + x)
        return F.struct(j.alias("no"), low.alias("low"), n.alias("n"), words.alias("words"), F.xxhash64(F.slice("__h", low + 1, n)).alias("hash"))

    steps = [
        ("__lines", F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")),
        ("__h", F.transform("__lines", lambda s: F.xxhash64(s))),
        ("__w", F.transform("__lines", lambda s: F.regexp_count(s, F.lit(WORD_PATTERN)))),
        ("__ends", F.filter(index, ends)),
    ]
    return steps, F.transform("__ends", chunk)


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """withColumn by a generator of one row: the optimizer then can't copy column into the lambdas that use it."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def line_runs(least: int) -> tuple[list[tuple[str, Column]], Column]:
    """Columns to add to __w, and the array of (low, size) of the runs of two lines or more.

    They are the shortest of least words from each line with words, forwards and backwards. Lines without words
    are left out first, so that a run is among least lines.
    """
    scale = 1000  # words * scale + lines

    def lines(part: Column) -> Column:
        full = F.lit(least * scale).cast("long")
        held = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: F.when(a >= full, a).otherwise(a + x.cast("long") * scale + 1))
        return F.when(held >= full, (held % scale).cast("int")).otherwise(0)

    def run(low: Column, high: Column) -> Column:
        low = F.element_at("__nb", low)
        return F.struct(low.alias("low"), (F.element_at("__nb", high) - low + 1).alias("size"))

    places = F.sequence(F.lit(1), F.size("__nb"))
    places = F.when(F.size("__nb") > 1, places).otherwise(F.array().cast("array<int>"))
    forward = F.transform(places, lambda p: F.struct(p.alias("p"), lines(F.slice("__wb", p, F.lit(least))).alias("n")))
    first = lambda p: F.greatest(p - least + 1, F.lit(1))
    backward = F.transform(places, lambda p: F.struct(p.alias("p"), lines(F.reverse(F.slice("__wb", first(p), p - first(p) + 1))).alias("n")))
    steps = [
        ("__nb", F.filter(F.sequence(F.lit(0), F.size("__w") - 1), lambda i: F.element_at("__w", i + 1) > 0)),
        ("__wb", F.filter("__w", lambda w: w > 0)),
        ("__on", F.filter(forward, lambda r: r["n"] > 1)),
        ("__back", F.filter(backward, lambda r: r["n"] > 1)),
    ]
    ahead = F.transform("__on", lambda r: run(r["p"], r["p"] + r["n"] - 1))
    return steps, F.array_union(ahead, F.transform("__back", lambda r: run(r["p"] - r["n"] + 1, r["p"])))


def _places(cut: DataFrame, least: int) -> DataFrame:
    """A row for each run: __id, *KEY, hash, low, size. cut: rows with __h and __w."""
    steps, runs = line_runs(least)
    rows = cut.select("__id", *KEY, "__h", "__w")
    for name, column in steps:
        rows = _once(rows, name, column)
    rows = rows.select("__id", *KEY, "__h", F.inline(runs))
    return rows.select("__id", *KEY, F.xxhash64(F.slice("__h", F.col("low") + 1, F.col("size"))).alias("hash"), "low", "size")


def _passages(cut: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """(*KEY, low, size) of repeated runs but the first of each, which they do not overlap. rows: *KEY, __text."""
    places = materialize(_places(cut, least))
    counted = places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("__id", *KEY, "low")).alias("first")).where("n > 1")
    named = places.join(counted.select("hash", "first"), "hash").withColumn("is_first", F.struct("__id", *KEY, "low").eqNullSafe(F.col("first")))
    own = (F.col("first.__k1") == F.col(KEY[0])) & (F.col("first.__k2") == F.col(KEY[1]))
    named = named.where(F.col("is_first") | ~own | (F.col("low") - F.col("first.low") >= F.col("size"))).select(*KEY, "hash", "low", "size", "is_first")
    # bytes of these runs only; a document's runs meet its text once
    listed = named.groupBy(*KEY).agg(F.collect_set(F.struct("hash", "low", "size", "is_first")).alias("__runs"))
    texts = rows.join(listed, KEY).dropDuplicates(KEY)
    texts = _once(texts.select(*KEY, "__runs", "__text"), "__lines", F.split("__text", "\n"))
    found = texts.select(*KEY, "__lines", F.inline("__runs"))
    found = materialize(found.withColumn("bytes", F.array_join(F.slice("__lines", F.col("low") + 1, F.col("size")), "\n")).drop("__lines"))
    originals = found.where("is_first").select("hash", F.col("bytes").alias("original")).dropDuplicates(["hash"])
    return found.where("not is_first").join(originals, "hash").where(F.col("bytes") == F.col("original")).select(*KEY, "low", "size")


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 2, one_in: int = 4, long_words: int = 16, passage_words: int | None = None) -> DataFrame:
    """df with repeated chunks and runs cut out of text, and columns n_lines, removed_lines, removed_chunks (both kinds).

    Lines are separated by \\n. The first occurrence, by doc_id (null first) and then position, stays; equal rows
    count as one document and share its fate. A null text stays null with one empty line; lines without words are
    never a chunk by themselves; an empty table gives an empty table. Without passage_words only chunks are removed. Very long
    texts are cut like others, a row at a time; columns of df with the new names are replaced, all others stay.
    """
    own = [c for c in df.columns if c not in ("n_lines", "removed_lines", "removed_chunks")]
    rest = [c for c in own if c != text]
    rows = df.select(packed(rest).alias("own"), F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    body = F.coalesce(F.col("__text"), F.lit(""))
    key = [F.xxhash64(F.lit(salt), F.col("__id"), body).alias(k) for salt, k in enumerate(KEY, 1)]
    steps, chunks = _chunks("__text", window, one_in, long_words)
    cut = rows.select("__id", "__text", *key)
    for name, column in steps:
        cut = _once(cut, name, column)
    cut = cut.withColumn("__chunks", F.filter(chunks, lambda c: ((c["n"] > 1) & (c["words"] > 0)) | (c["words"] >= long_words)))
    listed = cut.select("__id", *KEY, "__lines", F.explode("__chunks").alias("c"))
    places = listed.select("__id", *KEY, "c.no", "c.hash")
    counted = places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("__id", *KEY, "no")).alias("first")).where("n > 1")
    firsts = materialize(counted.select("hash", "first"))
    # texts of nominated chunks only
    found = listed.select("__id", *KEY, "c.*", F.array_join(F.slice("__lines", F.col("c.low") + 1, F.col("c.n")), "\n").alias("bytes")).withColumnRenamed("n", "size")
    found = materialize(found.join(firsts, "hash"))
    is_first = F.struct("__id", *KEY, "no").eqNullSafe(F.col("first"))
    originals = found.where(is_first).select("hash", F.col("bytes").alias("original")).dropDuplicates(["hash"])
    again = found.where(~is_first).join(originals, "hash").where(F.col("bytes") == F.col("original"))
    gone = again.select(*KEY, "low", "size")
    if passage_words:
        gone = gone.union(_passages(cut, rows.select(*key, body.alias("__text")), passage_words))
    gone = gone.groupBy(*KEY).agg(F.collect_set(F.struct("low", "size")).alias("__gone"))
    out = rows.select("own", "__text", *key).join(gone, KEY, "left")
    out = _once(out, "__lines", F.split(body, "\n"))
    drop = F.array_distinct(F.flatten(F.transform("__gone", lambda g: F.sequence(g["low"], g["low"] + g["size"] - 1))))
    out = _once(out, "__drop", drop)
    out = _once(out, "__kept", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop")))
    clean = F.array_join(F.transform("__kept", lambda i: F.element_at("__lines", i + 1)), "\n")
    result = [F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(clean).alias(c) if c == text else F.col("own").getField(c).alias(c) for c in own]
    none = F.lit(0)
    return out.select(
        *result, F.size("__lines").alias("n_lines"),
        F.when(F.col("__gone").isNull(), none).otherwise(F.size("__drop")).alias("removed_lines"),
        F.when(F.col("__gone").isNull(), none).otherwise(F.size("__gone")).alias("removed_chunks"),
    )
