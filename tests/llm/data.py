"""Small tables for the tests of this folder."""

import pyarrow.dataset as ds

DATA = "/root/testdata"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(sf="sf0.001", n=None):
    rows = ds.dataset(f"{DATA}/{sf}/documents.parquet").to_table().sort_by("doc_id").to_pylist()
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows][:n]


def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    line = "Some words of a line that is long enough to be a chunk by itself when it occurs again somewhere else."
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b ", None, "a", 5),
        (4, "one", "en", None, 3),
        (4, "one", "en", None, 3),
        (None, "two words", "en", "b", None),
        (None, line, None, None, None),
        (5, f"{line}\n{line}\nend", "en", "b", 10),
        (6, f"{line}\nother", "en", "b", 10),
        (7, "wörd " * 60_000, "de", "c", 300_000),
        (8, " ".join(f"w{i % 997}x{i}" for i in range(20_000)), "en", "c", 1),
        (9, "ABC def GHI", "en", "d", 11),
        (10, "abc DEF ghi", "en", "d", 11),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


#: Names that operators use inside.
INTERNAL = ["own", "key", "k1", "k2", "part", "block", "node", "of", "class", "rows", "i", "at", "p", "n", "z_piece", "__text", "__id", "__key", "__size", "__kept", "__lines", "__k1", "__k2"]


def clashing(df):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "shard", "slot", "taken", "target", "source_size", "pieces", "fingerprint", "component_id", "n_words", "kept", "base_failed", "n_lines", "removed_lines", "removed_chunks", "severity", "grade", "toxic", "score", "rank", "word", "row", "hash", "start", "length", "ids", *INTERNAL]
    return df.select("*", *[F.lit("extra").alias(n) for n in names])


def edge_tables(spark):
    rows = frame(spark, odd_rows())
    return {"odd": rows, "clashing": clashing(rows), "empty": rows.limit(0)}
