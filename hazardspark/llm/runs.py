"""Periodic runs of words by the runs theorem.

A run is a maximal stretch of words with smallest period q and two periods or more. Every run holds a Lyndon root: the longest Lyndon word that
begins at some place of its first period, under the order of words or under the opposite one. The longest Lyndon word at a place ends before the next
suffix that is smaller, that is, at the next smaller value of the inverse suffix array. Each place has so two candidate roots; a root of length
q at i is extended to the right by the longest common prefix of the suffixes at i and i + q, which is a range minimum of the LCP array (sparse table), and to the left
by the largest k for which the suffixes k places earlier agree on k words.

A task works through blocks of whole documents: suffixes are ranked within their documents, so copies in a block cost no comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import packed, unpacked

#: Words of a block of documents; a longer document is a block of its own.
BLOCK_WORDS = 1 << 18
MIN_LENGTH, MIN_EXPONENT = 6, 4


class Suffixes:
    """Ranks of the suffixes of documents laid end to end, and the common prefixes of suffixes of the same document."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        """codes: whole numbers from 0; starts: where documents begin, and the end of the last."""
        n = len(codes)
        lengths = np.diff(starts)
        self.n, self.end = n, np.repeat(starts[1:], lengths)
        key = np.repeat(np.arange(len(lengths)), lengths) * (int(codes.max(initial=0)) + 1) + codes
        self.order = np.argsort(key, kind="stable")
        fresh = np.diff(key[self.order], prepend=-1) != 0
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        self.levels = [self._placed(self.order, first)]
        #: Ranks with the end of a document below all words, and above them.
        opposite = self._refined(self.order.copy(), self.levels[0].copy(), n)
        self.rank = self._refined(self.order, self.levels[0], -1, self.levels)
        self.opposite = n - 1 - opposite
        self.lcp = self._minima(self._neighbours())

    @staticmethod
    def _placed(order: np.ndarray, first: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = first
        return rank

    def _refined(self, order: np.ndarray, rank: np.ndarray, beyond: int, levels: list | None = None) -> np.ndarray:
        """Double the length that ranks (the places of the first suffix of an equal group) tell apart, among those that are not alone. Each step's ranks go to levels."""
        alone = np.diff(rank[order], prepend=-1, append=-1) != 0
        at, h = np.flatnonzero(~(alone[:-1] & alone[1:])), 1
        while len(at):
            of = order[at]
            group, next_ = rank[of], of + h
            inside = next_ < self.end[of]
            second = np.where(inside, rank[np.where(inside, next_, 0)], beyond)
            by = np.lexsort((second, group))
            of, group, second = of[by], group[by], second[by]
            order[at] = of
            new = (np.diff(group, prepend=-1) != 0) | (np.diff(second, prepend=-2) != 0)
            rank = rank if levels is None else rank.copy()
            rank[of] = np.maximum.accumulate(np.where(new, at, 0))
            if levels is not None:
                levels.append(rank.astype(np.int32))
            last = np.append(new[1:], True)
            at, h = at[~(new & last)], 2 * h
        return rank

    def _neighbours(self) -> np.ndarray:
        """At a rank, the common prefix with the suffix of the rank before; 0 across documents."""
        lcp = np.zeros(self.n, dtype=np.int64)
        a, b = self.order[:-1], self.order[1:]
        # pairs that agree on 2**k words, for each k; later ones are parts of earlier ones
        agree = [np.flatnonzero(self.levels[0][a] == self.levels[0][b])]
        for level in self.levels[1:]:
            agree.append(agree[-1][level[a[agree[-1]]] == level[b[agree[-1]]]])
        top = np.full(self.n - 1 if self.n else 0, -1)
        for k, pairs in enumerate(agree):
            top[pairs] = k
        pairs, length = agree[0], np.zeros(len(top), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            some = pairs[top[pairs] >= k]
            i, j = a[some] + length[some], b[some] + length[some]
            inside = (i < self.end[a[some]]) & (j < self.end[b[some]])
            some, i, j = some[inside], i[inside], j[inside]
            same = self.levels[k][i] == self.levels[k][j]
            length[some[same]] += 1 << k
        lcp[1:] = length
        return lcp

    def _minima(self, values: np.ndarray) -> list[np.ndarray]:
        """Minima of 1, 2, 4, ... values from each place, as far as documents are long."""
        longest = int((self.end - np.arange(self.n)).max(initial=1))
        out, width = [values.astype(np.int32)], 1
        while 2 * width <= longest:
            last = out[-1]
            out.append(np.minimum(last[: len(last) - width], last[width:]) if len(last) > width else last[:0])
            width *= 2
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes at i and j, different places of one document each."""
        low, high = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j]) + 1
        k = np.frexp(high - low)[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for level in np.unique(k):
            some = k == level
            table = self.lcp[level]
            out[some] = np.minimum(table[low[some]], table[high[some] - (1 << int(level))])
        return out

    def next_smaller(self, values: np.ndarray) -> np.ndarray:
        """The next place in the document whose value is smaller, or the document's end. Steps double until they fail, then halve."""
        tables = self._minima(values)
        at, fails = np.arange(1, self.n + 1), np.zeros(self.n, dtype=np.int64)

        def clear(some: np.ndarray, k: int) -> np.ndarray:
            """Whether the next 2**k places of each are in the document and not smaller."""
            place = at[some]
            inside = place + (1 << k) <= self.end[some]
            return inside & (tables[k][np.where(inside, place, 0)] > values[some])

        active, k = np.arange(self.n), 0
        while len(active) and k < len(tables):
            going = clear(active, k)
            fails[active[~going]] = k
            active = active[going]
            at[active] += 1 << k
            k += 1
        fails[active] = k
        waiting = np.flatnonzero(fails > 0)
        for k in range(int(fails.max(initial=0)) - 1, -1, -1):
            some = waiting[fails[waiting] > k]
            at[some[clear(some, k)]] += 1 << k
        return at


def runs(codes: np.ndarray, starts: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, end, period) of the runs of max(min_length, min_exponent * period) words or more, in order of place and period."""
    if min_exponent < 2:
        raise ValueError("a run has two periods or more")
    s = Suffixes(codes, starts)
    found = []
    for values in (s.rank, s.opposite):
        end = s.next_smaller(values)
        i = np.flatnonzero(end < s.end)
        # of a run, the first root begins in its first period, so all but that and the root is common to both suffixes
        i = i[codes[i] == codes[end[i]]]
        period = end[i] - i
        right = s.common(i, i + period)
        enough = right > (min_exponent - 2) * period
        found.append((i[enough], (i + period + right)[enough], period[enough]))
    i, end, period = (np.concatenate(x) for x in zip(*found))
    # of roots of one run the first
    by = np.lexsort((i, period, end))
    i, end, period = i[by], end[by], period[by]
    one = (np.diff(end, prepend=-1) != 0) | (np.diff(period, prepend=-1) != 0)
    i, end, period = i[one], end[one], period[one]
    document = starts[np.searchsorted(starts, i, side="right") - 1]
    low, high = np.zeros(len(i), dtype=np.int64), np.minimum(i - document, period - 1)
    while (open_ := np.flatnonzero(low < high)).size:
        k = (low[open_] + high[open_] + 1) // 2
        back = i[open_] - k
        good = s.common(back, back + period[open_]) >= k
        low[open_[good]] = k[good]
        high[open_[~good]] = k[~good] - 1
    first = i - low
    long_ = end - first >= np.maximum(min_length, min_exponent * period)
    by = np.lexsort((period[long_], first[long_]))
    return first[long_][by], end[long_][by], period[long_][by]


def _worked(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    lists = pc.ascii_split_whitespace(texts)
    words, of = lists.flatten(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    some = pc.greater(pc.binary_length(words), 0)  # spaces at the ends of a text give empty strings
    words, of = words.filter(some), of[some.to_numpy(zero_copy_only=False)]
    starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    first, end, period = runs(codes, starts, min_length, min_exponent)
    # words after a run's first period go
    gone = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(gone, first + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[starts]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept))), " ")
    document = np.searchsorted(starts, first, side="right") - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(document, minlength=len(texts)))])
    values = [pa.array(x, pa.int64()) for x in (first - starts[document], end - first, period)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, ["start", "length", "period"])), joined


def _blocks(texts: pa.Array, block_bytes: int) -> Iterator[tuple[int, int]]:
    ends, low = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while low < len(texts):
        before = int(ends[low - 1]) if low else 0
        high = min(len(texts), max(low + 1, int(np.searchsorted(ends, before + block_bytes, side="right"))))
        yield low, high
        low = high


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without text, with runs (array of start, length, period in words, by start and period) and collapsed: the text without what repeats.

    Runs have max(min_length, min_exponent * period) words or more (min_exponent is 2 or more). collapsed joins by one space the words that no run contains after its first period.
    Null, empty and blank texts have no runs and an empty collapsed text; a very long text is worked through whole, with memory that grows with it (some 400 bytes a word);
    repeated rows are treated alike; an empty table gives an empty table; other columns stay, but for ones named runs or collapsed, which are replaced.
    """
    own = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    rows = docs.select(packed(own).alias("own"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for low, high in _blocks(texts, 6 * block_words):
                part = texts.slice(low, high - low)
                found, collapsed = _worked(part, min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), found, collapsed], ["own", "runs", "collapsed"])

    kind = rows.schema["own"].dataType.simpleString()
    out = rows.mapInArrow(run, f"own {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.select(*unpacked(own), "runs", "collapsed")
