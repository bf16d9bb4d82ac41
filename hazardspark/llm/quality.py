"""Quality rules from tokeniser fertility, with rejection bands per language.

Public vocabularies are read as instruments: how many characters a token covers, which share of tokens are
byte fallbacks, and how much entropy the tokens of a text have against the entropy that texts of its length
have in its language. Texts in a language that its vocabulary handles alike give values in a narrow band;
shouting, symbol soup, word salad and repetition leave it. The bands are robust (median and scaled
quartile distances) over all rows of a language that pass the base rules, so they cover the whole corpus.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardspark.llm import vocab
from hazardspark.llm.common import few, materialize, packed, text_bytes, unpacked

#: Characters that count as symbols (fixed values of the contract).
SYMBOLS = b"#*$%&|<>"
CHUNK = 1 << 20

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SIGNALS = "piece_chars double, byte_chars double, fallback double, entropy double"


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in three-word windows found at least twice."""
    continued = sum(len(w) for w in words) - sum(_continuation(w) for w in words if not w.isascii())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else []
    repeats = len(lines) - len(set(lines))
    n = len(words)
    covered = 0
    if n >= 4:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        if len(number) <= n - 2:  # without three words in all that occur before there is no repeated window
            ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
            m = len(number)
            windows = (ids[:-2] * m + ids[1:-1]) * m + ids[2:] if m < 2_000_000 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].reshape(-1)
            order = np.argsort(windows, kind="stable")
            same = windows[order][1:] == windows[order][:-1]
            if same.any():
                twice = np.zeros(n, dtype=bool)
                for at in (order[1:][same], order[:-1][same]):
                    for k in range(3):
                        twice[at + k] = True
                covered = int(twice.sum())
    return n, continued, symbols, repeats, covered


def _continuation(word: bytes) -> int:
    """UTF-8 bytes of a word that begin no code point."""
    return len(word) - len(word.decode("utf-8", "replace")) if b"\xef\xbf\xbd" not in word else sum(0x80 <= b < 0xC0 for b in word)


class Fertility:
    """Token counts of whole texts, word by word."""

    def __init__(self, piece_file: str, byte_file: str):
        self.pieces, self.bytes = vocab.pieces(piece_file), vocab.byte_bpe(byte_file)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.cache = vocab.Cache(self._encode, 200_000)

    def _encode(self, words: list[bytes]) -> list[tuple[bytes, int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids = self.pieces.encode(texts, num_threads=1)
        return [(np.array(x, dtype="<u2").tobytes(), len(self.bytes.encode_ordinary(" " + t))) for x, t in zip(ids, texts)]

    def signals(self, words: list[bytes], chars: int) -> tuple[float | None, float | None, float | None, float | None]:
        """Characters per token of both vocabularies, byte-fallback share, entropy in bits a token; nulls without words."""
        if not words:
            return None, None, None, None
        known = list(map(self.cache.known.__getitem__, words))
        ids = np.frombuffer(b"".join([k[0] for k in known]), dtype="<u2")
        n = len(ids)
        if not n:
            return None, None, None, None
        ordered = np.sort(ids)
        edges = np.flatnonzero(np.diff(ordered, prepend=-1, append=65_536))
        counts = np.diff(edges)
        entropy = math.log2(n) - float((counts * np.log2(counts)).sum()) / n
        return chars / n, chars / sum([k[1] for k in known]), float(self.fallback[ids].mean()), entropy


@functools.cache
def fertility(piece_file: str, byte_file: str) -> Fertility:
    return Fertility(piece_file, byte_file)


def measure(docs: DataFrame, text: str = "text", piece_file: str | None = None, byte_file: str | None = None) -> DataFrame:
    """docs without text, with the base counts and the fertility signals of each whole text (null: empty)."""
    piece_file = piece_file or vocab.path("piece_bpe_32k.model")
    byte_file = byte_file or vocab.path("byte_bpe_50k.tiktoken")
    types = [pa.int64()] * 5 + [pa.float64()] * 4
    names = [x.split()[0] for x in f"{BASE}, {SIGNALS}".split(", ")]

    def run(batches):
        meter = fertility(piece_file, byte_file)

        def rows_of(texts: list[bytes]) -> list[tuple]:
            split = [t.split() for t in texts]
            late = meter.cache.extend(chain.from_iterable(split))
            out = []
            for t, words in zip(texts, split):
                base = base_counts(t, words)
                out.append((*base, *meter.signals(words, base[1])))
            meter.cache.forget(late)
            return out

        for batch in batches:
            at = batch.schema.names.index("__text")
            rows, texts, held = [], [], 0
            for x in batch.column(at):
                texts.append(x.as_py() or b"")
                held += len(texts[-1])
                if held >= CHUNK:
                    rows += rows_of(texts)
                    texts, held = [], 0
            rows += rows_of(texts)
            new = [pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(types)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(columns + new, [x for i, x in enumerate(batch.schema.names) if i != at] + names)

    own = [c for c in docs.columns if c != text and c not in names]
    rows = docs.select(packed(own).alias("own"), text_bytes(f"`{text}`").alias("__text"))
    schema = T.StructType([rows.schema["own"], *T._parse_datatype_string(f"{BASE}, {SIGNALS}").fields])
    return rows.mapInArrow(run, schema).select(*unpacked(own), *names)


#: Base rules of the contract: words at least, and repeated words in percent at most.
LEAST_WORDS, MOST_REPEATED = 50, 50


def _middle(column: str, digits: int, *points: float):
    """Exact quantiles of values on a grid: the state is bounded by the grid and the result is the same in any order."""
    return F.percentile(F.round(column, digits), F.array(*[F.lit(p) for p in points]))


def _scale(column: str, digits: int):
    q = _middle(column, digits, 0.25, 0.75)
    return (F.element_at(q, 2) - F.element_at(q, 1)) / 1.349


def judge(measured: DataFrame, lang: str = "lang", combined: float = -4.0, single: float = -3.5, most: float = 8.0, most_fallback: float = 0.2, least_rows: int = 20) -> DataFrame:
    """measured with z_piece, z_byte, z_entropy, base_failed and kept.

    Of the rows that pass the base rules, per language: characters per token of both vocabularies against their median, in scaled quartile
    distances of deviations times sqrt(words); and entropy against the median of its length class (powers of two
    of words, all languages together) and then of its language, in scaled quartile distances of its length class. Rejected
    are rows whose distances of pieces (the lesser of both vocabularies') and of entropy sum to less than ``combined``, whose entropy lies below
    ``single``, one of whose three distances is above ``most``, or with over
    ``most_fallback`` byte fallbacks when their language's median has less than half of that. A language or length class with fewer than
    ``least_rows`` rows, or without spread, gives distance 0.
    """
    own = measured.columns
    names = [x.split()[0] for x in f"{BASE}, {SIGNALS}".split(", ")]
    rows = measured.select(packed(own).alias("own"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("of"), *names)
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    rows = rows.withColumn("class", F.floor(F.log2(F.greatest("n_words", F.lit(1)))))
    good = rows.where(~F.col("base_failed")).drop("own")
    by_class = few(good.groupBy("class").agg(F.element_at(_middle("entropy", 3, 0.5), 1).alias("e_class")))
    good = good.join(by_class, "class").withColumn("e1", F.col("entropy") - F.col("e_class"))
    by_lang = good.groupBy("of").agg(
        F.count("*").alias("rows"), F.element_at(_middle("piece_chars", 3, 0.5), 1).alias("p_lang"), F.element_at(_middle("byte_chars", 3, 0.5), 1).alias("b_lang"),
        F.element_at(_middle("e1", 3, 0.5), 1).alias("e_lang"), F.element_at(_middle("fallback", 3, 0.5), 1).alias("f_lang"),
    )
    by_lang = few(by_lang)
    good = good.join(by_lang, "of").withColumn("e2", F.col("e1") - F.col("e_lang"))
    good = good.withColumn("p2", (F.col("piece_chars") - F.col("p_lang")) * F.sqrt("n_words")).withColumn("b2", (F.col("byte_chars") - F.col("b_lang")) * F.sqrt("n_words"))
    e_scale = good.groupBy("class").agg(F.count("*").alias("class_rows"), _scale("e2", 3).alias("e_scale"))
    scales = good.groupBy("of").agg(_scale("p2", 2).alias("p_scale"), _scale("b2", 2).alias("b_scale"))
    rows = rows.join(few(by_class.join(e_scale, "class")), "class", "left").join(few(by_lang.join(scales, "of")), "of", "left")
    enough = F.col("rows") >= least_rows

    def distance(value: str, middle: str, scale: str) -> Column:
        return F.when(enough & (F.col(scale) > 0), (F.col(value) - F.col(middle)) * F.sqrt("n_words") / F.col(scale)).otherwise(0.0)

    z_entropy = F.when(enough & (F.col("class_rows") >= least_rows) & (F.col("e_scale") > 0), (F.col("entropy") - F.col("e_class") - F.col("e_lang")) / F.col("e_scale")).otherwise(0.0)
    rows = rows.withColumn("z_piece", distance("piece_chars", "p_lang", "p_scale")).withColumn("z_byte", distance("byte_chars", "b_lang", "b_scale")).withColumn("z_entropy", z_entropy)
    odd = (F.least("z_piece", "z_byte") + F.col("z_entropy") < combined) | (F.col("z_entropy") < single) | (F.greatest("z_piece", "z_byte", "z_entropy") > most)
    odd = odd | (enough & (F.col("fallback") > most_fallback) & (F.col("f_lang") < most_fallback / 2))
    return rows.select(*unpacked(own), "z_piece", "z_byte", "z_entropy", "base_failed", (~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).alias("kept"))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without text, with base counts, fertility signals, distances, base_failed and kept.

    A null or empty text has no words and fails the base rules; null lang is a language of its own; whole texts are measured, however
    long; repeated rows are judged alike; an empty table gives an empty table. Columns of docs with the new names are replaced, all others stay.
    """
    new = {"z_piece", "z_byte", "z_entropy", "base_failed", "kept"}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return judge(materialize(measure(docs.select(*own), text)), lang)
