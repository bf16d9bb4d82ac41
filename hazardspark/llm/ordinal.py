"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w . x): all ordered thresholds share the weights. The model is
fitted on the driver on a bounded sample of labelled rows (``sample`` toxic and twice as many others, by
hash of doc_id; their whole texts); scoring is one pass over all whole texts. Labels say only whether a document is toxic,
so toxic rows of the sample are graded 1 to 3 by terciles of the amount of telling features (words and beginnings of words over four times
as frequent in toxic rows as in others, with a likelihood-ratio statistic of ``least`` or more). The features that grade a row
are chosen on the other half of the sample, so a row's severity does not rest on its own label or words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardspark.llm.common import map_texts, packed, text_bytes, unpacked

#: Toxic rows that the sample takes at most.
SAMPLE = 2000
_STRIP = b".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without punctuation around them."""
    return [w for w in (w.strip(_STRIP) for w in text.lower().split()) if w]


def spread(word: bytes) -> Iterator[bytes]:
    """A word and its beginnings of 4 to 8 bytes (with a mark that no word has)."""
    yield word
    for k in range(4, min(8, len(word) - 1) + 1):
        yield word[:k] + b" "


def features_of(counts: Counter, kept: set[bytes] | dict[bytes, int]) -> Counter:
    """Counts of the kept features in a row."""
    out: Counter = Counter()
    for w, n in counts.items():
        for f in spread(w):
            if f in kept:
                out[f] += n
    return out


def evidence(a: int, n: int, b: int, m: int) -> float:
    """Likelihood-ratio statistic of a in n against b in m."""
    p = (a + b) / (n + m)
    term = lambda x, k: (x * math.log(x / k / p) if x else 0.0) + ((k - x) * math.log((1 - x / k) / (1 - p)) if x < k else 0.0)
    return 2 * (term(a, n) + term(b, m)) if 0 < p < 1 else 0.0


@dataclass(frozen=True)
class Model:
    words: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, text: bytes) -> np.ndarray:
        """Probabilities of the grades from 0."""
        return self.of(Counter(words_of(text)))

    def of(self, counts: Counter) -> np.ndarray:
        total = sum(self.weights[self.words[f]] * (1 + math.log(n)) for f, n in features_of(counts, self.words).items())
        below = 1 / (1 + np.exp(np.clip(total - self.thresholds, -50, 50)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def telling(toxic: list[Counter], clean: list[Counter], features: int, least: float) -> list[bytes]:
    """Features that tell toxic rows from others, the strongest first; if none reaches ``least``, the twenty strongest.

    Of features that begin alike and are in as many rows only the longest counts.
    """
    if not toxic or not clean:
        return []
    in_toxic = Counter(f for c in toxic for f in {f for w in c for f in spread(w)})
    in_clean = Counter(f for c in clean for f in {f for w in c for f in spread(w) if f in in_toxic})
    gain = {f: evidence(n, len(toxic), in_clean[f], len(clean)) for f, n in in_toxic.items() if n * len(clean) > 4 * in_clean[f] * len(toxic)}
    order = sorted(gain, key=lambda f: (-gain[f], f))
    strong = [f for f in order if gain[f] >= least] or order[:20]
    longest = {}
    for f in sorted(strong, key=lambda f: (len(f.rstrip()), f)):
        longest[f[:4], in_toxic[f], in_clean[f]] = f
    kept = set(longest.values())
    return [f for f in strong if f in kept][:features]


def loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, t: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with its penalty, and the gradient by weights and t: the first threshold, then the logs of the steps."""
    k = len(t)
    th = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
    eta = x @ w
    edges = np.concatenate([[-np.inf], th, [np.inf]])
    hi, lo = (1 / (1 + np.exp(np.clip(eta - edges[y + s], -50, 50))) for s in (1, 0))
    p = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    g_eta = (d_hi - d_lo) / len(y)
    g_th = np.array([(-(d_hi * (y == j)) + d_lo * (y == j + 1)).sum() for j in range(k)]) / len(y)
    g_t = np.concatenate([[g_th.sum()], [g_th[j:].sum() * math.exp(t[j]) for j in range(1, k)]])
    return float(-np.log(p).mean() + decay / 2 * (w @ w)), np.concatenate([x.T @ g_eta + decay * w, g_t])


def fit(rows: list[tuple[int, Counter]], grades: int = 4, features: int = 500, least: float = 20.0, steps: int = 500, decay: float = 1e-4) -> Model:
    """rows: (toxic 0 or 1, word counts). With one class only, every text gets the grade of that class with certainty."""
    toxic, clean = ([c for y, c in rows if y == kind] for kind in (1, 0))
    if not toxic or not clean:
        return Model({}, np.zeros(0), np.full(grades - 1, 50.0 if not toxic else -50.0))
    chosen = telling(toxic, clean, features, least)
    words = {w: i for i, w in enumerate(chosen)}
    # a half's rows are graded by the other half's features; a single toxic row by its own
    amount = np.zeros(len(toxic))
    for half in (0, 1):
        other = set(telling(toxic[1 - half :: 2], clean[1 - half :: 2], features, least)) or words
        amount[half::2] = [sum(1 + math.log(n) for n in features_of(c, other).values()) for c in toxic[half::2]]
    cuts = np.quantile(amount, np.arange(1, grades - 1) / (grades - 1))
    y = np.concatenate([1 + np.searchsorted(cuts, amount, side="right"), np.zeros(len(clean), dtype=np.int64)])
    x = np.zeros((len(rows), len(words)))
    for r, c in enumerate([*toxic, *clean]):
        for f, n in features_of(c, words).items():
            x[r, words[f]] = 1 + math.log(n)
    w, t = np.zeros(x.shape[1]), np.concatenate([[1.0], np.zeros(grades - 2)])
    moments = [np.zeros(len(w) + len(t)) for _ in range(2)]
    for step in range(1, steps + 1):
        g = loss(x, y, w, t, decay)[1]
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, t = w - move[: len(w)], t - move[len(w) :]
    return Model(words, w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def sample_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, sample: int) -> list[tuple[int, Counter]]:
    marks = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{toxic}`").cast("int").alias("toxic")).na.drop()
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit(5), "doc_id"), F.col("doc_id")]
    chosen = marks.where("toxic = 1").orderBy(*order).limit(sample).union(marks.where("toxic = 0").orderBy(*order).limit(2 * sample))

    def make():
        def of(value: bytes) -> tuple[bytes]:
            counts = Counter(words_of(value)).items()
            return (b"\n".join(b"%d %s" % (n, w) for w, n in counts),)

        return of

    # chosen: at most 3 * sample rows
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = map_texts(rows.select("doc_id", "toxic", text_bytes().alias("__text")), T.StructType([T.StructField("counts", T.BinaryType())]), make)
    found = sorted((r["doc_id"], r["toxic"], bytes(r["counts"])) for r in rows.collect())
    return [(y, Counter({w: int(n) for n, w in (x.split(b" ", 1) for x in c.split(b"\n") if x)})) for _, y, c in found]


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """docs without text, with severity (expected grade, 0 to 3), grade (the median grade) and toxic (grade above 0).

    A null or empty text is scored as one without words, a very long one whole; rows with null doc_id are scored but never learnt from;
    of several labels of a doc_id the toxic one holds, and repeated rows with a label are learnt from each;
    with no labels of one kind all rows get the other kind's grade; an empty table gives an empty table. Columns of
    docs with these names are replaced, all others stay.
    """
    model = fit(sample_rows(docs, labels, doc_id, text, toxic, sample))

    def make():
        def of(value: bytes) -> tuple[float, int, bool]:
            p = model.grades(value)
            grade = int(np.searchsorted(np.cumsum(p), 0.5))
            return float(p @ np.arange(len(p))), grade, grade > 0

        return of

    own = [c for c in docs.columns if c not in (text, "severity", "grade", "toxic")]
    new = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])
    rows = map_texts(docs.select(packed(own).alias("own"), text_bytes(f"`{text}`").alias("__text")), new, make)
    return rows.select(*unpacked(own), *new.names)
