"""Bounded-space online packing of token ids into sequences of fixed length.

Each task reads its rows once and keeps a fixed number of open windows. A piece goes into the open
window that it fits best; when it fits none, the fullest window is emitted (topped up with the head
of the piece if more than ``max_gap`` places are free) and an empty one opened. Windows still open at
a task's end are leftovers; those of ``MERGE_TASKS`` tasks at a time are merged, longest pieces first,
by the same rule, level by level, until one group is left. What a task or a merge holds is bounded by
open windows times sequence length, whatever the corpus.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import vocab
from hazardspark.llm.common import materialize, text_bytes

#: Tasks whose leftovers meet in one merge.
MERGE_TASKS = 32
#: Ids of sequences: a task's or merge group's number times this, plus a count.
SEQUENCES = 1 << 32
#: Bytes of texts tokenised, and of rows sent back, at a time.
CHUNK = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed boolean, task long"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("closed", pa.bool_()), ("task", pa.int64()),
])


class Packer:
    """Open windows of pieces (doc_id, start, ids as bytes of 4 each, tokens of the document)."""

    def __init__(self, base: int, task: int, capacity: int, windows: int, max_gap: int):
        self.next, self.task, self.capacity, self.windows, self.max_gap = base, task, capacity, windows, max_gap
        self.open: list[tuple[int, int]] = []  # (free places, window), in order
        self.pieces: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []
        self.held = 0

    def _new(self, piece: tuple, n: int) -> None:
        window, self.next = self.next, self.next + 1
        self.pieces[window] = [piece]
        if n == self.capacity:
            self._emit(window, True)
        else:
            insort(self.open, (self.capacity - n, window))

    def _emit(self, window: int, closed: bool) -> None:
        offset = 0
        for doc, start, ids, tokens in self.pieces.pop(window):
            n = len(ids) // 4
            self.rows.append((doc, start, n, ids, zlib.crc32(ids), tokens, window, offset, closed, self.task))
            offset += n
            self.held += len(ids)

    def add(self, doc: int | None, start: int, ids: bytes, tokens: int) -> None:
        size = 4 * self.capacity
        while len(ids) > size:
            self._new((doc, start, ids[:size], tokens), self.capacity)
            start, ids = start + self.capacity, ids[size:]
        n = len(ids) // 4
        at = bisect_left(self.open, (n, -1))
        if at < len(self.open):
            free, window = self.open.pop(at)
            self.pieces[window].append((doc, start, ids, tokens))
            if free == n:
                self._emit(window, True)
            else:
                insort(self.open, (free - n, window))
        elif len(self.open) < self.windows:
            self._new((doc, start, ids, tokens), n)
        else:
            free, window = self.open.pop(0)
            if free > self.max_gap:
                self.pieces[window].append((doc, start, ids[: 4 * free], tokens))
                start, ids, n = start + free, ids[4 * free :], n - free
            self._emit(window, True)
            self._new((doc, start, ids, tokens), n)

    def finish(self, closed: bool) -> None:
        while self.open:
            self._emit(self.open.pop(0)[1], closed)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(_ARROW)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def word_bpe_ids(file: str, end: int) -> Callable[[], Callable[[list[bytes]], list[bytes]]]:
    """Ids of whole texts by word_bpe_49k.json, each followed by the id end."""

    def make():
        words, tail = vocab.word_bpe(file), end.to_bytes(4, "little")
        return lambda texts: [ids + tail for ids in words.ids(texts)]

    return make


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 2048, windows: int = 64, max_gap: int = 16, vocabulary: str | None = None, end: int = 1) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each row's text (null: empty), the closing ``end`` included, lies in exactly one piece; the pieces of a
    sequence tile it from offset 0. Sequences have at most ``length`` ids. Rows with equal or null doc_id are packed
    like others; other columns are ignored; an empty table gives an empty table. vocabulary: path of the file.
    """
    tokens_of = word_bpe_ids(vocabulary or vocab.path("word_bpe_49k.json"), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, encode = Packer(task * SEQUENCES, task, length, windows, max_gap), tokens_of()

        def feed(ids: list, texts: list[bytes]) -> None:
            for doc, found in zip(ids, encode(texts)):
                packer.add(doc, 0, found, len(found) // 4)

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py() or b""
                ids.append(doc)
                texts.append(value)
                held += len(value)
                if held >= CHUNK:
                    feed(ids, texts)
                    ids, texts, held = [], [], 0
                    if packer.held >= 4 * CHUNK:
                        yield packer.batch()
            feed(ids, texts)
            yield packer.batch()
        packer.finish(False)
        yield packer.batch()

    def merge(depth: int, last: bool) -> Callable[[pa.Table], pa.Table]:
        def of(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("sequence_id", "ascending")])
            group = rows.column("task")[0].as_py() // MERGE_TASKS
            # a merge's sequences are numbered within one of its tasks, in that level's own eighth
            task = max(rows.column("sequence_id").to_pylist()) // SEQUENCES
            packer = Packer(task * SEQUENCES + depth * (SEQUENCES // 8), group, length, windows, max_gap)
            for doc, start, ids, n in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                packer.add(doc, start, ids, n)
            packer.finish(last)
            return pa.Table.from_batches([packer.batch()])

        return of

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_bytes(f"`{text}`").alias("__text"))
    level = materialize(rows.mapInArrow(run, SCHEMA))
    done = level.where("closed")
    tasks = (level.agg(F.max("task")).first()[0] or 0) + 1
    for depth in range(1, 8):
        last = tasks <= MERGE_TASKS
        group = F.floor(F.col("task") / MERGE_TASKS)
        level = level.where("not closed").groupBy(group).applyInArrow(merge(depth, last), SCHEMA)
        if last:
            return done.union(level).drop("closed", "task")
        level = materialize(level)
        done = done.union(level.where("closed"))
        tasks = -(-tasks // MERGE_TASKS)
    raise ValueError("more tasks than seven levels of merges take")
