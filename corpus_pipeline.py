"""A corpus pipeline of five of the llm operators: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() applies them to documents, each stage's rows written to the shared scratch folder first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardspark.llm import linededup, mix, pack, quality, simhash
from hazardspark.llm.common import materialize, packed, table, unpacked

#: Two hashes over all columns, by which a stage joins its decisions back to the rows.
KEY = ["k1", "k2"]


def _keyed(docs: DataFrame, *used: str) -> DataFrame:
    """docs' columns as the struct own, the keys, and the used columns beside them, so that no names clash."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(packed(docs.columns).alias("own"), *[F.xxhash64(F.lit(salt), *columns).alias(k) for salt, k in enumerate(KEY, 1)], *[F.col(f"`{c}`") for c in used])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fertility bands of their language.

    A null, empty or blank text has no words and goes; a very long one is measured whole; null lang is a language of its own; repeated rows are
    judged alike and all stay or go; ties are at the bands' inner side; an empty table gives an empty table; other columns pass through, whatever their names.
    """
    rows = _keyed(docs, "lang", "text")
    kept = quality.quality(rows.select(*KEY, "lang", "text")).where("kept").select(*KEY).distinct()
    return rows.join(kept, KEY, "left_semi").select(*unpacked(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without line chunks and runs of lines that occur earlier; a text that loses all its words goes. n_chars follows the text.

    The first occurrence, by doc_id (null first) and then place, stays; equal rows count as one document and share its fate. Null, empty and blank texts
    lose nothing and stay; very long texts are cut whole; an empty table gives an empty table; other columns pass through, whatever their names.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(packed(rest).alias("own"), "doc_id", "text")
    rows = linededup.dedup_lines(rows, passage_words=linededup.PASSAGE_WORDS).where((F.col("removed_chunks") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("own").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates (0.8 of five-word shingles).

    Texts without words (null, empty, blank) are alike and one group; a group whose doc_ids are all null keeps all its rows but repeated texts; of repeated
    doc_ids one row stays, the first by a hash of all columns; very long texts are compared whole; an empty table gives an empty table; other columns pass through, whatever their names.
    """
    rows = _keyed(docs, "doc_id", "text")
    groups = simhash.near_duplicates(rows.select("doc_id", "text"), width=5, percent=80)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi")
    one = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(*KEY)
    return rows.withColumn("n", F.row_number().over(one)).where("n = 1").select(*unpacked(docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (a part of half or more counts as the whole), in the mix's order.

    Null, empty and blank texts are never taken and go; a very long text is taken whole or not; null source is a source of its own, the last; repeated rows are
    taken as often as they are together; an empty table gives an empty table; other columns pass through, whatever their names.
    """
    rows = _keyed(docs, "source", "text")
    narrow = rows.select(*KEY, "source", mix.word_count(F.col("text")).alias("n_words"))
    parts = mix.mix(narrow, size="n_words").select(*KEY, "size", F.explode("pieces").alias("p"))
    whole = parts.groupBy(*KEY, "p.key", "p.epoch").agg(F.sum("p.n_words").alias("n"), F.min(F.struct("p.shard", "p.place")).alias("at"), F.first("size").alias("size"))
    # equal rows share keys, so what they take together may be over their size
    places = whole.withColumn("times", F.floor(F.col("n") / F.col("size") + 0.5).cast("int")).where("times > 0")
    places = places.groupBy(*KEY).agg(F.collect_list(F.struct("at.shard", "at.place", "key", "times")).alias("places"))
    found = rows.select("own", *KEY).join(places, KEY)
    found = found.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*KEY))).where("n = 1")
    found = found.select("own", F.inline("places").alias("shard", "place", "key", "times"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "times")))
    found = found.repartition("shard", F.floor(F.col("place") / 64)).sortWithinPartitions("shard", "place", "key")
    return found.select(*unpacked(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids (the last stage: it returns pack.pack's columns).

    A null or empty text is its closing id; a very long one is cut freely; repeated rows and null doc_ids are packed like others; an empty table
    gives an empty table; other columns are ignored.
    """
    return pack.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs)
    return docs
