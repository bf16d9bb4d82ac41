"""Interaction of filters by inclusion and exclusion.

Each document fails some of k filters. A pass over the documents counts, for each of the 2**k sets of filters, the documents that fail all of
them: sums of products of flags. All else follows from these joint failures J by inversion, in whole numbers:

* survivors of a set P of filters are the sum of (-1)**|S| J(S) over the subsets S of P (the empty one counts all documents);
* a filter's removals at a step of an order are the survivors before it less those after it, and what it would have removed too is redundant;
* documents that fail one filter only are the sum of (-1)**(|S| - 1) J(S) over the sets S that hold it;
* removal by any filter of P is a game with the Harsanyi dividends (-1)**(|S| + 1) J(S), which a Shapley value shares equally among the filters
  of S: over all orders, k! / |S| of it each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from math import factorial
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import WORD_PATTERN

#: The filters of text_failures, a letter each.
FILTERS = "ABCDE"
#: More filters would have more than 40,320 orders.
MOST_FILTERS = 8
#: Measures of the audit: all documents, those labelled good and those labelled toxic.
MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text (null: empty) fails A (under 50 words), B (under 65 in 100 words distinct), C (over 5 in 100 code points A-Z), D (any of #$%&*|)."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): documents of a part with these failures, and how many of them are labelled.

    E: identical to the text of any smaller doc_id, by SHA-256. The first of equal texts is found by aggregation and met by (text, doc_id), so no key is as hot as a group
    of copies. Rows with a null doc_id have no smaller one, are none, and have no labels; of equal doc_ids with equal texts none is the smaller;
    repeated rows count each. A doc_id with several label rows is good or toxic if any of them says so. Null parts are the empty one.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256).alias("key"), *[c.alias(k) for k, c in text_failures(F.col(f"`{text}`")).items()],
    )
    # repeated rows as one, so none is hot in the joins by id
    rows = rows.groupBy("id", "part", "key", *FILTERS[:4]).agg(F.count("*").alias("n"))
    first = rows.where("id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["key", "id"], "left").withColumn("E", F.col("first").isNull() & F.col("id").isNotNull())
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name) for c, name in (("quality", "is_good"), ("toxic", "is_toxic"))])
    rows = rows.join(marks, "id", "left")
    counts = [F.sum(F.col("n") * F.coalesce(F.col(f"is_{m}"), F.lit(0))).alias(m) for m in MEASURES[1:]]
    return rows.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), *counts)


def joint_failures(rows: DataFrame, filters: Sequence[str], measures: Sequence[str], by: str = "part") -> DataFrame:
    """by, and for each measure an array: at place S (a bit a filter) the measure's sum over the rows that fail all filters of S."""
    none = F.lit(1).cast("long")
    flag = [F.col(f"`{f}`").cast("long") for f in filters]
    products = [reduce(mul, [x for i, x in enumerate(flag) if s >> i & 1], none) for s in range(1 << len(filters))]
    return rows.groupBy(by).agg(*[F.array(*[F.sum(F.col(m) * p) for p in products]).alias(m) for m in measures])


def _sign(s: Column) -> Column:
    return F.when(F.bit_count(s) % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).cast("long")


def _over_sets(k: int, of) -> Column:
    """Sum over all sets S of k filters."""
    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << k) - 1)), F.lit(0).cast("long"), lambda sum_, s: sum_ + of(s))


def survivors(joint: Column, k: int) -> Column:
    """Array: at place P the documents that pass all filters of P, from the joint failures."""
    within = lambda s, p: s.bitwiseAND(p) == s
    return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda p: _over_sets(k, lambda s: F.when(within(s, p), _sign(s) * F.get(joint, s)).otherwise(0)))


def shapley(joint: Column, k: int, bit: Column) -> Column:
    """A filter's removals summed over all k! orders, from the dividends."""
    share = lambda s: (F.lit(factorial(k)) / F.bit_count(s)).cast("long")
    return _over_sets(k, lambda s: F.when(s.bitwiseAND(bit) == bit, -_sign(s) * share(s) * F.get(joint, s)).otherwise(0))


def unique_failures(joint: Column, k: int, bit: Column) -> Column:
    """Documents that fail this filter and no other."""
    return _over_sets(k, lambda s: F.when(s.bitwiseAND(bit) == bit, -_sign(s) * F.get(joint, s)).otherwise(0))


def audit(rows: DataFrame, filters: Sequence[str], measures: Sequence[str], by: str = "part") -> DataFrame:
    """by, filter_order, step, kept, removed, redundant, unique_fails, shapley and {measure}_lost for each order, step and value of by.

    rows: by, a boolean column a filter (null: passes) and the measures (whole numbers, the first of them the number of documents); rows of any number are
    summed. Filters have names of one letter. An empty table gives no rows.
    """
    k = len(filters)
    if not 1 <= k <= MOST_FILTERS or any(len(f) != 1 for f in filters) or len(set(filters)) < k:
        raise ValueError(f"filters are 1 to {MOST_FILTERS} different letters")
    clean = rows.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in filters})
    # at most 2**k rows a part before the products
    clean = clean.groupBy(by, *filters).agg(*[F.sum(m).cast("long").alias(m) for m in measures])
    found = joint_failures(clean, filters, measures, by).select(
        by, F.col(measures[0]).alias("joint"), *[survivors(F.col(m), k).alias(f"left_{m}") for m in measures]
    )
    letters = "".join(filters)
    orders = found.select("*", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(filters)])).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    at = lambda i: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.substring("filter_order", i, F.lit(1))) - 1)
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda bits, i: F.when(i == 0, bits).otherwise(bits.bitwiseOR(at(i))))
    steps = steps.withColumn("bit", at(F.col("step"))).withColumn("before", before).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    lost = {m: F.get(f"left_{m}", F.col("before")) - F.get(f"left_{m}", F.col("after")) for m in measures}
    return steps.select(
        by, "filter_order", "step", F.get(f"left_{measures[0]}", F.col("after")).alias("kept"), lost[measures[0]].alias("removed"),
        (F.get("joint", F.col("bit")) - lost[measures[0]]).alias("redundant"), unique_failures(F.col("joint"), k, F.col("bit")).alias("unique_fails"),
        *[lost[m].alias(f"{m}_lost") for m in measures[1:]], shapley(F.col("joint"), k, F.col("bit")).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents, by source: 600 rows a source, in which null sources are the empty one.

    Null and empty texts have no words, very long texts are measured whole, ties and repeated rows are as in failures(), other columns are ignored
    whatever their names, and an empty table gives no rows.
    """
    return audit(failures(docs, labels), FILTERS, MEASURES)
