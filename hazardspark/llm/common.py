"""What the operators of this subpackage share: tables, scratch tables and words.

A *word* is a maximal run of characters other than space and the ASCII controls
0x09 to 0x0D. On UTF-8 bytes that is exactly ``bytes.split()``, and ``bytes.lower()``
lower-cases exactly A-Z, so Python workers handle the raw bytes of a text.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_scratch() -> str:
    return tempfile.mkdtemp(prefix="hazardspark-scratch-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where it is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_scratch()


#: For tables of rows of many megabytes: Parquet looks at the size of a row group after each row (not first after 100), and ends it at 16 MB.
LONG_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def materialize(df: DataFrame, compression: str = "zstd", **options: str) -> DataFrame:
    """Write df to the shared scratch folder, with the writer's options, and read it back.

    This cuts the lineage: a lost executor later costs a re-read, never the work done here.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/hs-{uuid.uuid4().hex}"
    df.write.options(compression=compression, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df written to scratch, and marked for broadcast if it has at most so many rows; else joined like any other."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= most else df


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of string texts, A-Z lower-cased, and the number of the text of each."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, of = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)  # spaces at the ends of a text give empty strings
    return words.filter(some).dictionary_encode(), of[some.to_numpy(zero_copy_only=False)]


def packed(names: list[str]) -> Column:
    """The named columns as one struct, under which a caller's names can't clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(True).alias("none"))


def unpacked(names: list[str], struct: str = "own") -> list[Column]:
    """The columns of packed() again."""
    return [F.col(struct).getField(c).alias(c) for c in names]


def map_texts(df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[bytes], tuple]]) -> DataFrame:
    """Replace the binary column ``__text`` by columns computed from each value.

    make() runs once per task and returns the function of one text; schema lists the new columns.
    """
    kept = [f for f in df.schema.fields if f.name != "__text"]
    arrow = [(f.name, _ARROW[type(f.dataType)]) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            at = batch.schema.names.index("__text")
            rows = [of(x.as_py() or b"") for x in batch.column(at)]
            new = [pa.array([r[i] for r in rows], type=kind) for i, (_, kind) in enumerate(arrow)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(columns + new, names + [n for n, _ in arrow])

    return df.mapInArrow(run, T.StructType(kept + list(schema.fields)))


_ARROW = {
    T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(),
    T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(),
}
