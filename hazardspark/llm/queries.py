"""The queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardspark.llm import audit, html, linededup, lm, mix, ordinal, pack, phrases, quality, runs, search, shard, simhash
from hazardspark.llm.common import WORD_PATTERN, table, text_bytes


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_attention_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents")).drop("ids")


def op4_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(rows, passage_words=linededup.PASSAGE_WORDS)


def op5_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.quality(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(rows, rows.where("doc_id % 100 = 0"))


def op7_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_bytes()
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard.shard(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ordinal.toxicity(rows, table(spark, sf_dir, "labels"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mix.word_count(F.col("text")).alias("n_words"))
    return mix.mix(rows, size="n_words").select("doc_id", "size", "source_size", "target", "taken", "pieces")


def op11_phrase_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _made_periodic(doc_id: Column, text: Column) -> Column:
    """The contract's text: of one doc_id in ten, words from a place on repeat a stretch of words (a null doc_id is none of them)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), F.ceil((n - a) / p).cast("int")))
    made = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), F.lit(1), n)
    return F.when((h % 10 == 0) & text.rlike(WORD_PATTERN), F.array_join(made, " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", _made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.find_runs(rows)
    # runs are in order of start and period, so the first of equal exponents stays
    better = lambda x, best: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    found = found.withColumn("best", F.aggregate("runs", none, lambda best, x: F.when(better(x, best), x).otherwise(best)))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("best").getField(c).alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_near_dedup, op2_attention_scoring, op3_online_packing, op4_line_chunk_dedup, op5_token_fertility, op6_block_max_search, op7_hypergeometric_sharding, op8_html_extraction, op9_ordinal_toxicity, op10_source_mixing, op11_phrase_decontamination, op12_filter_audit, op13_periodic_runs)
}

#: DuckDB SQL of the queries that SQL can express whole.
ORACLE_SQL: dict[str, str] = {
    "op6_block_max_search": """
        WITH w AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word
            FROM documents),
        tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
        dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
        stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS average),
        idf AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY word, n),
        scored AS (
            SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / average))), 6) AS score
            FROM tf q JOIN tf d USING (word) JOIN idf USING (word) JOIN dl ON dl.doc_id = d.doc_id, stats
            WHERE q.doc_id % 100 = 0 GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
    "op11_phrase_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        windows AS (
            SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS phrase
            FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0) q) r),
        places AS (
            SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM windows) s) q),
        found AS (SELECT DISTINCT doc_id, item, p, n FROM places JOIN windows USING (n, phrase)),
        hit AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM found, generate_series(0, 9) ks(k) WHERE k < n GROUP BY doc_id),
        of_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN of_items USING (doc_id)""",
    "op12_filter_audit": """
        WITH w AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
        flags AS (
            SELECT part, CAST(len(words) < 50 AS INTEGER) AS a, CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER) AS b,
                CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS INTEGER) AS c, CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) AS d,
                CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS INTEGER) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
            FROM w LEFT JOIN marks USING (doc_id)),
        cells AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
        f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders AS (
            SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM f p, f q, f r, f s, f t
            WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
        steps AS (SELECT filter_order, k AS step, bits[k] AS bit, list_sum(bits[:k - 1]) AS before FROM orders, generate_series(1, 5) ks(k)),
        run AS (
            SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (coalesce(before, 0)::INTEGER | bit) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & coalesce(before, 0)::INTEGER = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & coalesce(before, 0)::INTEGER > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & coalesce(before, 0)::INTEGER = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & coalesce(before, 0)::INTEGER = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM cells, steps GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM run""",
}
