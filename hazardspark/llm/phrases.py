"""Phrases of test items in a corpus by a distributed positional inverted index.

build_index writes the index in one pass without a shuffle: each task lays the words of the documents that it reads on axes of bounded length,
one index row an axis, with the places of each term in order (a free place between documents keeps phrases apart). The index serves any number of test sets.

Test items travel to the tasks in blocks of bounded size, each a pass over the index. On an axis, the distinct windows of the items are looked up together: the
places of each window's rarest term, less the term's offset in the window, are the candidate beginnings; the lists of the other terms, from rare to frequent, are
intersected with them at their offsets. With a slop of 0 what is left are the exact phrases; with more, every word may stand up to slop places from where the phrase would have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import materialize, packed, unpacked

#: Words of a window; an item of fewer is one window.
WIDTH = 10
#: Text bytes of an axis and documents of one; words of the items of a block, on average; candidates that a task holds at a time.
AXIS_BYTES, AXIS_DOCS, BLOCK_WORDS, CANDIDATES = 8 << 20, 1 << 16, 1_000_000, 1 << 21

#: Words are runs of 0-9, a-z (A-Z count as these) and of all bytes of characters beyond ASCII; other bytes part them.
_FOLD = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)
_FOLD[65:91] += 32


def split_folded(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of string texts, A-Z lower-cased, and the number of the text of each."""
    _, offsets, data = texts.buffers()
    if data is None:
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    folded = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(folded)], offset=texts.offset))
    words, of = lists.flatten(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)  # spaces at the ends of a text give empty strings
    return words.filter(some), of[some.to_numpy(zero_copy_only=False)]


# --- the index


def axis_of(own: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """begins (place of each document's first word, and the axis's end), words, counts and places of these documents, as arrays of one value."""
    words, of = split_folded(texts)
    terms = words.dictionary_encode()
    lengths = np.bincount(of, minlength=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    codes = terms.indices.to_numpy()
    place = np.arange(len(codes)) + of
    by = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=len(terms.dictionary))
    # gaps between places pack better than places
    gaps = np.diff(place[by], prepend=0).astype("<i4").tobytes()
    lists = [own, pa.array(begins, pa.int32()), terms.dictionary, pa.array(counts, pa.int32())]
    return [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists] + [pa.array([gaps], pa.binary())]


def build_index(docs: DataFrame, text: str = "text", axis_bytes: int = AXIS_BYTES, axis_docs: int = AXIS_DOCS) -> DataFrame:
    """The positional index of docs, written to the scratch folder: axis, own (docs' other columns, a struct a document), begins, words, counts, places.

    Rows are indexed as they are: null and empty texts have no words, a text longer than axis_bytes is an axis of its own, repeated rows are documents each.
    """
    own = [c for c in docs.columns if c != text]
    rows = docs.select(packed(own).alias("own"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    names = ["axis", "own", "begins", "words", "counts", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count, axis = [], 0, 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal size, count, axis
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            size = count = 0
            axis += 1
            return pa.RecordBatch.from_arrays([pa.array([axis], pa.int64()), *axis_of(*(c.chunk(0) for c in whole.columns))], names)

        for batch in batches:
            ends, low = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)), 0
            while low < batch.num_rows:
                before = int(ends[low - 1]) if low else 0
                high = min(batch.num_rows, low + axis_docs - count, int(np.searchsorted(ends, before + axis_bytes - size, side="right")))
                if high <= low:  # the next text is too long for what the axis holds
                    if held:
                        yield out()
                        continue
                    high = low + 1
                held.append(batch.slice(low, high - low))
                size, count, low = size + int(ends[high - 1]) - before, count + high - low, high
                if size >= axis_bytes or count >= axis_docs:
                    yield out()
        if held:
            yield out()

    kind = rows.schema["own"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"axis long, own array<{kind}>, begins array<int>, words array<string>, counts array<int>, places binary"))


class Axis:
    """Places of terms on an axis, asked for many at a time."""

    def __init__(self, begins: np.ndarray, words: pa.Array, counts: np.ndarray, gaps: bytes):
        self.begins, self.words, self.counts = begins, words, counts.astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.places = np.cumsum(np.frombuffer(gaps, dtype="<i4"), dtype=np.int64)
        self.size = int(begins[-1]) + 1
        # in order of term and place
        self.keys = np.repeat(np.arange(len(counts)), self.counts) * self.size + self.places

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has a place from low to high."""
        at = np.searchsorted(self.keys, term * self.size + low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= term * self.size + high)

    def find(self, windows: np.ndarray, slop: int = 0, most: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, document, place in it) of all matches, a bounded number of candidates at a time.

        windows: a row of terms each, -1 for a term that the axis lacks. A match begins at place s of a document if for every i the document has the window's word i within slop of place
        s + i; without slop that is the phrase itself, and with it s may lie up to slop places before the document, and a match may come more than once.
        """
        alive = np.flatnonzero((windows >= 0).all(axis=1))
        if not len(alive) or not len(self.keys):
            return
        rare = np.argsort(self.counts[windows[alive]], axis=1, kind="stable")
        lists = self.counts[windows[alive, rare[:, 0]]]
        # windows whose candidates fit; the list of a single term is cut further
        part = np.cumsum(lists * (2 * slop + 1)) // most
        for p in np.unique(part):
            some = np.flatnonzero(part == p)
            n = lists[some]
            total, step = int(n.sum()), max(1, most // (2 * slop + 1))
            starts = np.cumsum(n) - n
            for low in range(0, total, step):
                number = np.arange(low, min(total, low + step))
                row = np.searchsorted(starts, number, side="right") - 1
                w = some[row]
                term, offset = windows[alive[w], rare[w, 0]], rare[w, 0]
                place = self.places[self.first[term] + number - starts[row]]
                yield self._intersected(windows, alive, rare, w, place, offset, slop)

    def _intersected(self, windows, alive, rare, w, place, offset, slop) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        document = np.searchsorted(self.begins, place, side="right") - 1
        begin = place - offset
        if slop:
            shifts = np.arange(-slop, slop + 1)
            begin = (begin[:, None] + shifts).ravel()
            w, document = np.repeat(w, len(shifts)), np.repeat(document, len(shifts))
        for k in range(0 if slop else 1, windows.shape[1]):
            offset = rare[w, k]
            want = begin + offset
            # of the document: its places end one before the next document's free place
            low = np.maximum(want - slop, self.begins[document])
            high = np.minimum(want + slop, self.begins[document + 1] - 2)
            good = low <= high
            good[good] = self.holds(windows[alive[w[good]], offset[good]], low[good], high[good])
            w, document, begin = w[good], document[good], begin[good]
        if slop:
            # several places of the rarest term may give the same match
            rows = np.unique(np.stack([w, document, begin], axis=1), axis=0)
            w, document, begin = rows[:, 0], rows[:, 1], rows[:, 2]
        return alive[w], document, begin - self.begins[document]


# --- test items


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, sorted, and terms; by length of window, the distinct windows and which items (numbers of ids) have each."""

    ids: list[str]
    words: pa.Array
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # terms a row; where each row's items begin, and the end; the items


def items_of(ids: list[str], texts: list[str], width: int = WIDTH) -> Items:
    """Rows with the same id are one item."""
    known = sorted(set(ids))
    numbers = {x: n for n, x in enumerate(known)}
    number = np.array([numbers[x] for x in ids], dtype=np.int64)
    words, of = split_folded(pa.array(texts, pa.string()))
    terms = words.dictionary_encode()
    codes, starts = terms.indices.to_numpy().astype(np.int64), np.searchsorted(of, np.arange(len(ids) + 1))
    lengths = np.diff(starts)
    windows = []
    for size in np.unique(np.minimum(lengths[lengths > 0], width)):
        some = np.flatnonzero(np.minimum(lengths, width) == size)
        n = lengths[some] - size + 1
        row = np.repeat(some, n)
        begin = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[row]
        rows, which = np.unique(codes[begin[:, None] + np.arange(size)], axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), number[row]], axis=1), axis=0)
        windows.append((rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1]))
    return Items(known, terms.dictionary, windows)


def _stretches(of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of ranges [low, high) within each of; ranges that touch are one."""
    by = np.lexsort((low, of))
    of, low, high = of[by], low[by], high[by]
    far = int(high.max(initial=0)) + 2
    reach = np.maximum.accumulate(high + of * far)
    new = np.ones(len(of), dtype=bool)
    new[1:] = (low + of * far)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return of[at], low[at], reach[np.append(at[1:], len(of)) - 1] - of[at] * far if len(at) else high[:0]


def _search(batch: pa.RecordBatch, items: Items, slop: int) -> pa.RecordBatch:
    """One row a document of the axis: axis, document, n_words, and its stretches of words that an item's matches cover."""
    values = {name: batch.column(name)[0].values for name in ("begins", "words", "counts")}
    axis = Axis(values["begins"].to_numpy().astype(np.int64), values["words"], values["counts"].to_numpy(), batch.column("places")[0].as_py())
    lengths = np.diff(axis.begins) - 1
    here = pc.fill_null(pc.index_in(items.words, value_set=axis.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    documents, owners, lows, highs = [], [], [], []
    for rows, first, item in items.windows:
        size = rows.shape[1]
        for w, document, begin in axis.find(here[rows], slop):
            n = first[w + 1] - first[w]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[w], n)
            document, begin = np.repeat(document, n), np.repeat(begin, n)
            documents.append(document)
            owners.append(item[at])
            lows.append(np.maximum(begin - slop, 0))
            highs.append(np.minimum(begin + size + slop, lengths[document]))
    none = [np.zeros(0, dtype=np.int64)]
    document, owner, low, high = (np.concatenate(x or none) for x in (documents, owners, lows, highs))
    pair, low, high = _stretches(document * max(1, len(items.ids)) + owner, low, high)
    document, owner = np.divmod(pair, max(1, len(items.ids)))
    spans = pa.StructArray.from_arrays([pa.array(items.ids, pa.string()).take(pa.array(owner)), pa.array(low, pa.int64()), pa.array(high - low, pa.int64())], ["item_id", "start", "length"])
    offsets = np.searchsorted(document, np.arange(len(lengths) + 1))
    columns = [batch.column("axis").take(pa.array(np.zeros(len(lengths), dtype=np.int64))), pa.array(np.arange(len(lengths)), pa.int32()), pa.array(lengths, pa.int64())]
    columns += [batch.column("own")[0].values, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)]
    return pa.RecordBatch.from_arrays(columns, ["axis", "document", "n_words", "own", "spans"])


def _found(index: DataFrame, items: DataFrame, item_id: str, text: str, width: int, slop: int, block_words: int) -> DataFrame:
    """own, n_words and spans (item_id, start, length; by item and start) of every document, over all items."""
    if width < 1 or slop < 0:
        raise ValueError("width is 1 or more, slop is 0 or more")
    asked = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).distinct()
    asked = materialize(asked.withColumn("size", F.octet_length("text") / 6))
    blocks = max(1, math.ceil((asked.agg(F.sum("size")).first()[0] or 0) / block_words))
    kind = index.schema["own"].dataType.elementType.simpleString()
    spark, parts = index.sparkSession, []
    for i in range(blocks):
        # of bounded size: block_words words on average
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).select("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(items_of([r["item_id"] for r in rows], [r["text"] for r in rows], width))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    yield _search(batch.slice(n, 1), sent.value, slop)

        parts.append(index.mapInArrow(run, f"axis long, document int, n_words long, own {kind}, spans array<struct<item_id:string,start:long,length:long>>"))
    if len(parts) == 1:
        return parts[0].select("own", "n_words", "spans")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    # a row a block
    whole = whole.groupBy("axis", "document").agg(F.first("own").alias("own"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
    return whole.select("own", "n_words", F.array_sort("spans").alias("spans"))


def matches(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The index's own columns, item_id, start, length: stretches of document words (numbered from 0) that windows of an item cover.

    A window is width consecutive words of an item, an item of fewer words is one window; with slop a match covers slop words more on both sides. Ids are text, null the empty one; rows with one
    id are one item; items without words match nothing.
    """
    rows = _found(index, items, item_id, text, width, slop, block_words)
    own = rows.schema["own"].dataType.fieldNames()
    return rows.select("own", F.inline("spans")).select(*unpacked([c for c in own if c not in ("item_id", "start", "length")]), "item_id", "start", "length")


def _covered(spans: Column) -> Column:
    """Words that the spans cover together."""
    kind = "struct<n:bigint,reach:bigint>"
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")).cast(kind)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("low"), (s["start"] + s["length"]).alias("high"))))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["high"] - F.greatest(a["reach"], s["low"]))).alias("n"), F.greatest(a["reach"], s["high"]).alias("reach")).cast(kind)
    return F.aggregate(ordered, begin, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, slop: int = 0, block_words: int = BLOCK_WORDS, axis_bytes: int = AXIS_BYTES) -> DataFrame:
    """docs without text, with n_words, n_hit (words in a match of any item), items (sorted ids of the items that match, an array) and contaminated.

    A row for every row of docs: null, empty and blank texts have no words; very long texts are searched whole; repeated rows count each; items of no words (null, empty) match
    nothing; a null item_id counts as the empty one and items of one id as one; empty tables give no rows, or rows that nothing hits. Other columns stay, but for ones named like the new, which are replaced.
    """
    new = ["n_words", "n_hit", "items", "contaminated"]
    own = [c for c in docs.columns if c != text and c not in new]
    rows = _found(build_index(docs.select(*[f"`{c}`" for c in own], f"`{text}`"), text, axis_bytes), items, item_id, item_text, width, slop, block_words)
    hit = _covered(F.col("spans"))
    return rows.select(*unpacked(own), "n_words", hit.alias("n_hit"), F.array_sort(F.array_distinct("spans.item_id")).alias("items"), (F.size("spans") > 0).alias("contaminated"))
