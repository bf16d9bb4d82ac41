"""Exact top-k search by BM25 over an inverted index with block-max pruning.

One pass over the texts writes the index: each task turns the rows it reads into shards of bounded size, one row
with the postings of a shard, without a shuffle. Queries are taken in blocks of bounded size; the index is read once for
each block, whose terms travel to the tasks. In a shard, documents lie in blocks of like neighbours. A block's bound for a query is
the best of its documents by the query's rare terms, which are scored from their postings, plus the block's largest impacts
of the common terms. As in block-max WAND, a block whose bound can't reach the score of the k-th best document so far is skipped; the
first blocks tried are the most promising ones, and the k-th best scores pass on from shard to shard of a task. Statistics (documents,
lengths, document frequencies) are those of all documents, so the tasks' best k merge to the exact result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardspark.llm.common import LONG_ROWS, materialize, split_words

K1, B = 1.2, 0.75
#: Text bytes and documents of a shard; queries and query terms of a block, on average.
SHARD_BYTES, SHARD_DOCS, BLOCK_QUERIES, BLOCK_TERMS = 16 << 20, 1 << 14, 4096, 1_000_000
#: Neighbouring documents of an index block; queries scored at a time; scores are rounded to so many digits before ties go to the smaller doc_id.
BLOCK_DOCS, GROUP, DIGITS = 64, 256, 6
#: A term is common in a shard where this share of all pairs of documents and queries has it; postings of others are cheaper than columns.
COMMON = 0.005

_INDEX = "ids array<long>, lengths array<int>, words array<string>, df array<int>, docs binary, tf binary, n long, total long"
_INDEX_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after another."""
    n = high - low
    return np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)


def shard_of(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The index row of these documents."""
    words, of = split_words(texts)
    term, count, n = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary)), len(ids)
    lengths = np.bincount(of, minlength=n)
    key = np.sort(of * count + term)
    at = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(at, append=len(key))
    doc, term = np.divmod(key[at], count)
    # documents whose commonest terms agree are neighbours, so their blocks' maxima are alike
    first = np.full(n, -1)
    if len(doc):
        begins = np.flatnonzero(np.diff(doc, prepend=-1))
        most = np.flatnonzero(tf == np.repeat(np.maximum.reduceat(tf, begins), np.diff(begins, append=len(doc))))[::-1]
        first[doc[most]] = term[most]
    order = np.lexsort((lengths, first))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    doc = place[doc]
    by = np.lexsort((doc, term))
    lists = (ids.take(pa.array(order)), pa.array(lengths[order], pa.int32()), words.dictionary, pa.array(np.bincount(term, minlength=len(words.dictionary)), pa.int32()))
    values = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    values += [pa.array([x[by].astype("<i4").tobytes()], pa.binary()) for x in (doc, tf)] + [pa.array([x], pa.int64()) for x in (n, int(lengths.sum()))]
    return pa.RecordBatch.from_arrays(values, _INDEX_NAMES)


def _build(shard_bytes: int, shard_docs: int = SHARD_DOCS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return shard_of(*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns))

        for batch in batches:
            ends, low = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)), 0
            while low < batch.num_rows:
                before = int(ends[low - 1]) if low else 0
                high = min(batch.num_rows, low + shard_docs - count, int(np.searchsorted(ends, before + shard_bytes - size)) + 1)
                held.append(batch.slice(low, high - low))
                size, count = size + int(ends[high - 1]) - before, count + high - low
                low = high
                if size >= shard_bytes or count >= shard_docs:
                    yield out()
                    size = count = 0
        if held:
            yield out()

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, of = split_words(batch.column(1))
        count = max(1, len(words.dictionary))
        q, term = np.divmod(np.unique(of * count + words.indices.to_numpy().astype(np.int64)), count)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), words.dictionary.take(pa.array(term))], ["query_id", "word"])


@dataclass
class Queries:
    """A block of queries: query i has the terms numbered terms[ends[i - 1]:ends[i]]."""

    ids: np.ndarray
    words: pa.Array
    idf: np.ndarray
    terms: np.ndarray
    ends: np.ndarray


class Best:
    """The best k documents of each query so far: scores, doc_ids and whether these are null, best first."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.doc = np.zeros((queries, k), dtype=np.int64)
        self.null = np.zeros((queries, k), dtype=bool)

    def add(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Found documents, scores rounded."""
        some = np.unique(q)
        q = np.concatenate([q, np.repeat(some, self.k)])
        score, doc, null = (np.concatenate([x, old[some].ravel()]) for x, old in ((score, self.score), (doc, self.doc), (null, self.null)))
        order = np.lexsort((doc, null, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, place = (x[place < self.k] for x in (order, q, place))
        self.score[q, place], self.doc[q, place], self.null[q, place] = score[order], doc[order], null[order]


class Shard:
    """An index row prepared for the terms of a block of queries."""

    def __init__(self, row: pa.RecordBatch, asked: Queries, average: float, block_docs: int = BLOCK_DOCS):
        ids, lengths, words, df, docs, tf = (row.column(c)[0] for c in ("ids", "lengths", "words", "df", "docs", "tf"))
        self.asked, self.block_docs = asked, block_docs
        self.ids = ids.values.fill_null(0).to_numpy(zero_copy_only=False)
        self.null = ids.values.is_null().to_numpy(zero_copy_only=False)
        n = len(self.ids)
        self.blocks = -(-n // block_docs)
        number = pc.index_in(words.values, asked.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        here = np.flatnonzero(number >= 0)
        df = df.values.to_numpy(zero_copy_only=False).astype(np.int64)
        high = np.cumsum(df)
        post = _ranges((high - df)[here], high[here])
        self.doc = np.frombuffer(docs.as_buffer(), dtype="<i4")[post].astype(np.int64)
        tf = np.frombuffer(tf.as_buffer(), dtype="<i4")[post].astype(np.float64)
        norm = K1 * (1 - B + B * lengths.values.to_numpy(zero_copy_only=False).astype(np.float64) / max(average, 1e-9))
        df, number = df[here], number[here]
        self.weight = np.repeat(asked.idf[number], df) * (tf * (K1 + 1) / (tf + norm[self.doc]))
        self.high = np.cumsum(df)
        self.low = self.high - df
        # terms of the queries as places among the shard's
        place = np.full(len(asked.idf), -1, dtype=np.int64)
        place[number] = np.arange(len(number))
        of = np.repeat(np.arange(len(asked.ids)), np.diff(asked.ends, prepend=0))
        term = place[asked.terms]
        of, term = of[term >= 0], term[term >= 0]
        asking = np.bincount(term, minlength=len(number))
        common = np.flatnonzero(df * asking > COMMON * n * len(asked.ids))
        column = np.full(len(number), -1, dtype=np.int64)
        column[common] = np.arange(len(common))
        # common terms as columns: weights of the documents, their largest in each block, and who asks for them
        self.columns = np.zeros((self.blocks * block_docs, len(common)))
        post = _ranges(self.low[common], self.high[common])
        self.columns[self.doc[post], np.repeat(np.arange(len(common)), df[common])] = self.weight[post]
        self.top = self.columns.reshape(self.blocks, block_docs, len(common)).max(axis=1, initial=0.0)
        wanted = column[term] >= 0
        self.wants = np.zeros((len(common), len(asked.ids)))
        self.wants[column[term[wanted]], of[wanted]] = 1.0
        self.rare, rare_of = term[~wanted], of[~wanted]
        self.rare_ends = np.searchsorted(rare_of, np.arange(len(asked.ids)), side="right")
        self.scored = 0

    def search(self, best: Best) -> None:
        for low in range(0, len(self.asked.ids), GROUP):
            self._search(low, min(low + GROUP, len(self.asked.ids)), best)

    def _search(self, first: int, last: int, best: Best) -> None:
        """Queries first to last against all blocks."""
        size, n = self.block_docs, self.blocks * self.block_docs
        rare = np.zeros((last - first, n))
        for q in range(first, last):
            t = self.rare[self.rare_ends[q - 1] if q else 0 : self.rare_ends[q]]
            if len(t):
                post = _ranges(self.low[t], self.high[t])
                rare[q - first] = np.bincount(self.doc[post], weights=self.weight[post], minlength=n)
        rare = rare.reshape(last - first, self.blocks, size)
        bound = rare.max(axis=2) + (self.top @ self.wants[:, first:last]).T
        tried = np.argmax(bound, axis=1)
        go = np.zeros(bound.shape, dtype=bool)
        go[np.arange(len(tried)), tried] = True
        go &= bound > 0
        self._score(go, first, rare, best)
        done = go
        reach = best.score[first:last, -1] - 2 * 10.0**-DIGITS
        self._score((bound >= reach[:, None]) & (bound > 0) & ~done, first, rare, best)

    def _score(self, go: np.ndarray, first: int, rare: np.ndarray, best: Best) -> None:
        """Score the (query, block) cells of go in full, and keep what is among the best."""
        size, out = self.block_docs, []
        reach = best.score[first : first + len(go), -1]
        for b in np.flatnonzero(go.any(axis=0)):
            q = np.flatnonzero(go[:, b])
            at = slice(b * size, (b + 1) * size)
            scores = np.round(rare[q, b] + (self.columns[at] @ self.wants[:, first + q]).T, DIGITS)
            self.scored += len(q)
            good = (scores > 0) & (scores >= reach[q, None])
            if scores.shape[1] > best.k:  # of one block only the best k, and ties with the last of them
                good &= scores >= np.partition(scores, -best.k, axis=1)[:, -best.k, None]
            i, d = np.nonzero(good)
            out.append((q[i], scores[i, d], b * size + d))
        if out:
            q, score, d = (np.concatenate(x) for x in zip(*out))
            best.add(first + q, score, self.ids[d], self.null[d])


def top_k(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "doc_id", text: str = "text", k: int = 10, shard_bytes: int = SHARD_BYTES, block_queries: int = BLOCK_QUERIES, block_terms: int = BLOCK_TERMS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """query_id, rank, doc_id, score: the k documents of most BM25 score for each query text, its own row included.

    Terms are words with A-Z lower-cased; a query's terms count once. Documents without a common term are no result, so
    a null or empty query or document has none. Scores are rounded to 6 digits, ties go to the smaller doc_id (null
    last). Rows of queries with one query_id are one query of all their terms; repeated documents are results each; whole texts are
    indexed, however long; other columns are ignored; an empty table gives none. Ids are whole numbers (or text of one).
    """
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    index = materialize(texts.mapInArrow(_build(shard_bytes, shard_docs), _INDEX), **LONG_ROWS)
    n, words = (int(x or 0) for x in index.agg(F.sum("n"), F.sum("total")).first())
    average = words / n if n else 0.0
    counts = index.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("df").alias("df")))).groupBy("word").agg(F.sum("df").alias("df"))
    asked = queries.select(F.col(f"`{query_id}`").cast("long").alias("query_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    terms = asked.mapInArrow(_terms, "query_id long, word string")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # a query's own distinct terms make one row
    weighed = terms.join(counts, "word").groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("word", idf.alias("weight")))).alias("terms"))
    weighed = materialize(weighed.select("query_id", F.col("terms.word").alias("words"), F.col("terms.weight").alias("weights")))
    many, size = (int(x or 0) for x in weighed.agg(F.count("*"), F.sum(F.size("words"))).first())
    blocks = max(1, math.ceil(many / block_queries), math.ceil(size / block_terms))
    done = []
    for i in range(blocks):
        # of bounded size: block_queries queries and block_terms terms on average
        part = weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        best = materialize(_block_best(index, _block(part), average, k))
        done.append(best)
    found = done[0]
    for best in done[1:]:
        found = found.union(best)
    return found


def _block(rows: list) -> Queries:
    rows = sorted(rows, key=lambda r: (r["query_id"] is None, r["query_id"]))
    words, idf, terms = {}, [], []
    for r in rows:
        for w, x in zip(r["words"], r["weights"]):
            i = words.setdefault(w, len(words))
            if i == len(idf):
                idf.append(x)
            terms.append(i)
    ids = np.array([r["query_id"] for r in rows], dtype=object)
    return Queries(ids, pa.array(list(words), pa.string()), np.array(idf, dtype=np.float64), np.array(terms, dtype=np.int64), np.cumsum([len(r["words"]) for r in rows], dtype=np.int64))


def _block_best(index: DataFrame, asked: Queries, average: float, k: int) -> DataFrame:
    """query_id, rank, doc_id, score of a block of queries: the index is read once."""
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = Best(len(asked.ids), k)
        for batch in batches:
            for i in range(batch.num_rows):
                Shard(batch.slice(i, 1), asked, average).search(best)
        q, place = np.nonzero(best.score > 0)
        doc = pa.array(best.doc[q, place], mask=best.null[q, place])
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q].tolist(), type=pa.int64()), doc, pa.array(best.score[q, place])], ["query_id", "doc_id", "score"])

    found = index.select("ids", "lengths", "words", "df", "docs", "tf").mapInArrow(run, "query_id long, doc_id long, score double")
    # at most k rows of each task a query
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
