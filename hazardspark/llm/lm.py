"""Language-model scoring: a causal self-attention model on subword ids, mixed with corpus counts.

A word is spelt as the ids of a public byte BPE, the last one marked, so spellings are a prefix code and
the product of its units' probabilities is a distribution over words. The units' classes are predicted
by one layer of causal self-attention trained in numpy; a unit within
its class follows counts over the whole training corpus. Long texts are scored in overlapping windows, each
unit once, many windows at a time. Attention predicts the class k of a word's first unit; within the class the
word's share of the training corpus is mixed with its spelling under the model:

    P(w) = P(k | before) * ((1 - m) * c / (C_k + V_k) + ((1 - m) * V_k / (C_k + V_k) + m) * P(spelling | k, before))

where C_k and V_k count the training tokens and distinct tokens that begin in class k.

What is learnt grows with the corpus: word and unit counts, the known units, which unit follows which (and so the classes and the direct
weights) are counted over all training rows. The attention weights are trained on all training rows, dealt to
learners of bounded size that start from the same weights and pass over all their rows; their results are averaged in a tree. The scalar m is that of ``MIXING`` of most
leave-one-out likelihood over all training rows: rows are scored with each. The ``common`` most frequent words' counts travel to the tasks (a bounded table). Of other words a block of texts
asks once each: its words meet the full table of counts by hash, and their counts, alone, come back to the block's numbers.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm import vocab
from hazardspark.llm.common import LONG_ROWS, materialize, split_words, text_bytes

#: Words whose counts are broadcast; distinct words a task counts before it hands them on; bytes scored at a time.
COMMON, COUNTED, CHUNK = 100_000, 400_000, 1 << 20
#: Values of the scalar m; learners whose weights are averaged at a time; parts that the weights are cut into.
MIXING, TOGETHER, PARTS = (0.02, 0.05, 0.1, 0.2, 0.4), 64, 16
#: Rows and bytes of text that a learner gets, on average.
LEARNER_ROWS, LEARNER_BYTES = 1500, 16 << 20
#: Units known one by one; the others share places by frequency and by whether they end a word.
KNOWN = 3000
#: Learners trained one after another in a group and averaged there, where there are many: at most so many, and so many groups at least.
GROUPED, GROUPS = 4, 64
#: Tokens that a block asks counts for, about; bytes of all texts whose words share a part of the table of counts, about.
BLOCK, SHARED = 300_000, 12 << 20
#: Least steps of each learner, and windows a step: a small learner makes several passes over its rows, and each makes one.
STEPS, BATCH = 500, 96
#: Folds of crc32(doc_id): one of them is held out.
FOLDS, HELD_OUT = 7, 2


#: Words of visible ASCII characters and of those from U+00C0 to U+00FF.
_PLAIN = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\xbf])+")


class Speller:
    """Words to units: twice the id of the byte BPE, plus 1 for a word's last id."""

    def __init__(self, file: str):
        self.bpe = vocab.byte_bpe(file)
        self.end = 2 * (self.bpe.max_token_value + 1)
        self.units = self.end + 1
        self.sizes = np.zeros(self.bpe.max_token_value + 1, dtype=np.int64)
        for word in self.bpe.token_byte_values():
            self.sizes[self.bpe.encode_single_token(word)] = len(word)
        self.cache = vocab.Cache(self._encode, 200_000)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if _PLAIN.fullmatch(w)]
        for at in range(0, len(plain), 4096):
            # the vocabulary's split begins anew at a space before a visible character, so words joined by spaces have the units that each has by itself
            group = plain[at : at + 4096]
            units = np.array(self.bpe.encode_ordinary(" " + " ".join([words[i].decode() for i in group])), dtype="<i4")
            ends = np.searchsorted(np.cumsum(self.sizes[units]), np.cumsum([len(words[i]) + 1 for i in group]))
            units *= 2
            units[ends] += 1
            low = 0
            for i, high in zip(group, (ends + 1).tolist()):
                out[i] = units[low:high].tobytes()
                low = high
        for i, w in enumerate(words):
            if not out[i]:
                u = np.array(self.bpe.encode_ordinary(" " + w.decode("utf-8", "replace")), dtype="<i4") * 2
                u[-1] += 1
                out[i] = u.tobytes()
        return out


@functools.cache
def speller(file: str) -> Speller:
    return Speller(file)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class Attention:
    """P(class of the next unit | units so far), times P(unit | class)."""

    row: np.ndarray  # input row of a unit
    kind: np.ndarray  # class of a unit
    within: np.ndarray  # natural log of P(unit | class)
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    bias: np.ndarray  # by distance back
    direct: np.ndarray  # class logits by input row
    out: np.ndarray
    window: int = 32

    @property
    def stride(self) -> int:
        return self.window * 3 // 4

    def attend(self, rows: np.ndarray, first: int = 0) -> tuple[np.ndarray, ...]:
        """rows: (windows, window) of input rows; mixed values of places from first on, and what the gradient needs."""
        n = rows.shape[1]
        q, k, v = self.q[rows[:, first:]], self.k[rows], self.v[rows]
        back = np.arange(first, n)[:, None] - np.arange(n)[None, :]
        masked = np.where(back >= 0, self.bias[np.maximum(back, 0)], np.float32(-1e9)).astype(np.float32)
        a = np.matmul(q, k.transpose(0, 2, 1))
        a *= np.float32(1 / np.sqrt(q.shape[-1]))
        a += masked
        # at the scale of a row's largest logit, so that no row of small ones sums to 0
        a -= a.max(axis=-1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=-1, keepdims=True)
        return np.matmul(a, v), q, k, v, a

    def log_probs(self, texts: list[np.ndarray], block: int = 48) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Natural log probabilities of each unit's class, and of each unit, given the units before in its text."""
        if not texts:
            return [], []
        ends = np.cumsum([len(t) for t in texts])[:-1]
        first, whole = self.flat(np.concatenate(texts), np.array([len(t) for t in texts]), block)
        return np.split(first, ends), np.split(whole, ends)

    def flat(self, targets: np.ndarray, lengths: np.ndarray, block: int = 48) -> tuple[np.ndarray, np.ndarray]:
        """log_probs of texts one after another, of the given lengths."""
        start, overlap = len(self.direct) - 1, self.window - self.stride
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        kinds = self.kind[targets]
        inputs = np.empty(len(targets), dtype=np.int64)
        inputs[1:] = self.row[targets[:-1]]
        inputs[offsets[:-1][lengths > 0]] = start
        out = np.empty(len(targets), dtype=np.float32)
        # the first places of each text, and then windows whose first places only lend their past
        texts = np.flatnonzero(lengths > 0)
        counts = np.maximum(0, -(-(lengths - overlap) // self.stride))
        of = np.repeat(np.arange(len(lengths)), counts)
        number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        for begins, ends, width, first in (
            (offsets[texts], np.minimum(offsets[texts] + overlap, offsets[texts + 1]), overlap, 0),
            (offsets[of] + number * self.stride, offsets[of + 1], self.window, overlap),
        ):
            for at in range(0, len(begins), block):
                part = slice(at, at + block)
                places = begins[part, None] + np.arange(width)
                valid = (places < ends[part, None])[:, first:]
                rows = inputs[np.minimum(places, ends[part, None] - 1)]
                scored = places[:, first:][valid]
                logits = self.direct[rows[:, first:][valid]]
                logits += self.attend(rows, first)[0][valid] @ self.out
                picked = logits[np.arange(len(scored)), kinds[scored]]
                np.exp(np.minimum(logits, np.float32(80), out=logits), out=logits)  # logits start as log probabilities and stay small
                out[scored] = picked - np.log(logits.sum(axis=1))
        return out, out + self.within[targets]


def _neighbourhoods(pairs: np.ndarray, dim: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors and values of the Gram matrix of positive pointwise mutual information with both neighbours."""
    after, before = pairs.sum(1), pairs.sum(0)
    total, own = 2 * max(float(pairs.sum()), 1.0), after + before + 1
    i, j = np.nonzero(pairs)
    logs = np.log(pairs[i, j] * np.float32(total))
    left, right = np.zeros_like(pairs), np.zeros_like(pairs)
    left[i, j] = np.maximum(0, logs - np.log(own[i] * (before[j] + 1)))
    right[j, i] = np.maximum(0, logs - np.log(own[j] * (after[i] + 1)))
    x = rng.normal(size=(len(pairs), min(dim, len(pairs)))).astype(np.float32)
    for _ in range(8):  # subspace iteration: no matrix but the two is held
        x = np.linalg.qr(left @ (left.T @ x) + right @ (right.T @ x))[0]
    values, turn = np.linalg.eigh(x.T @ (left @ (left.T @ x) + right @ (right.T @ x)))
    return (x @ turn)[:, ::-1], np.maximum(values[::-1], 0)


@dataclass
class Alphabet:
    """Places of units: the known ones, then four shared places of others, the end, and the start of a text."""

    place: np.ndarray  # of each unit
    known: np.ndarray  # units, the most frequent first
    start: int

    @property
    def size(self) -> int:
        return self.start + 1


def alphabet(counts: np.ndarray, end: int, known: int = KNOWN) -> Alphabet:
    """From counts of all units in the training corpus."""
    seen = counts.copy()
    seen[end] = 0
    top = np.argsort(-seen, kind="stable")[:known]
    top = top[seen[top] > 0]
    often = counts > np.median(counts[counts > 0]) if (counts > 0).any() else np.zeros(len(counts), dtype=bool)
    place = len(top) + 2 * often + np.arange(len(counts)) % 2
    place[top] = np.arange(len(top))
    place[end] = len(top) + 4
    return Alphabet(place.astype(np.int64), top, len(top) + 5)


def follows(texts: list[np.ndarray], letters: Alphabet) -> np.ndarray:
    """counts[a, b]: how often place b follows place a in these texts."""
    n = letters.size
    out = np.zeros(n * n, dtype=np.int64)
    for t in texts:
        p = letters.place[t]
        np.add.at(out, np.concatenate([[letters.start], p[:-1]]) * n + p, 1)
    return out.reshape(n, n)


def initial(pairs: np.ndarray, letters: Alphabet, counts: np.ndarray, end: int, classes: int = 96, dim: int = 16, window: int = 32, seed: int = 3) -> Attention:
    """The untrained model: classes of the known units by their neighbours, direct weights from what follows what. pairs: follows() of the corpus."""
    rng = np.random.Generator(np.random.PCG64(seed))
    top, units = letters.known, len(counts)
    groups = classes - 5
    if len(top) > groups:
        u, s = _neighbourhoods(pairs[: len(top), : len(top)].astype(np.float32), 2 * dim, rng)
        points = u[:, :dim] * np.sqrt(np.sqrt(s[:dim]))
        points = np.concatenate([points / (np.linalg.norm(points, axis=1, keepdims=True) + 1e-9), 2.0 * (top % 2)[:, None]], axis=1)
        centres = points[np.arange(groups)].copy()
        for _ in range(15):
            near = (points @ centres.T) * 2 - (centres**2).sum(1)
            label = near.argmax(1)
            for g in range(groups):
                if (label == g).any():
                    centres[g] = points[label == g].mean(0)
    else:
        label = np.arange(len(top))
    # input rows: the known units, the classes (shared places are in the last ones), the start
    of_place = np.concatenate([label, groups + np.arange(5)])  # class of each place but the start
    kind = of_place[letters.place]
    row = np.where(letters.place < len(top), letters.place, len(top) + kind)
    rows = len(top) + classes + 1
    weight = counts + 0.1
    within = np.log(weight / np.bincount(kind, weights=weight, minlength=classes)[kind]).astype(np.float32)
    follow = np.zeros((rows, classes))
    at = np.concatenate([np.arange(len(top)), len(top) + groups + np.arange(5), [rows - 1]])
    for k in range(classes):
        follow[at, k] = pairs[:, :-1][:, of_place == k].sum(axis=1)
    share = (follow.sum(0) + 0.1) / (follow.sum() + 0.1 * classes)
    direct = np.log((follow + 5 * share) / (follow.sum(1, keepdims=True) + 5))
    p = {
        "q": rng.normal(0, 0.3, (rows, dim)), "k": rng.normal(0, 0.3, (rows, dim)), "v": rng.normal(0, 0.3, (rows, dim)),
        "bias": np.zeros(window), "direct": direct, "out": np.zeros((dim, classes)),
    }
    return Attention(row, kind, within, **{n: x.astype(np.float32) for n, x in p.items()}, window=window)


WEIGHTS = ("q", "k", "v", "bias", "direct", "out")


def trained(model: Attention, texts: list[np.ndarray], steps: int = STEPS, batch: int = BATCH, seed: int = 3, block: int = 48) -> Attention:
    """A copy of the model trained on these texts: each unit is learnt from at least once, in passes over all windows in random order, for at least so many steps."""
    rng = np.random.Generator(np.random.PCG64(seed))
    p = {n: getattr(model, n).copy() for n in WEIGHTS}
    model = replace(model, **p)
    window, dim, classes, start = model.window, model.q.shape[1], model.direct.shape[1], len(model.direct) - 1
    if not sum(map(len, texts)):
        return model
    short = [np.zeros(window, dtype=np.int64)]  # a stream has a window at least
    stream = np.concatenate([np.concatenate([[start], model.row[t]]) for t in texts] + [short[0] + start])
    goals = np.concatenate([np.concatenate([model.kind[t], [-1]]) for t in texts] + [short[0] - 1])
    windows = np.arange(0, len(stream) - window + 1, window)
    m1, m2, g = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(3))
    back = np.arange(window)[:, None] - np.arange(window)[None, :]
    begin = np.arange(0, len(windows), batch)
    steps = max(steps, len(begin))
    for step in range(1, steps + 1):
        at = (step - 1) % len(begin)
        if at == 0:
            order = rng.permutation(windows)
        chosen = order[begin[at] : begin[at] + batch]
        live_all = max(1, int((goals[chosen[:, None] + np.arange(window)] >= 0).sum()))
        for x in g.values():
            x.fill(0)
        for low in range(0, len(chosen), block):
            places = chosen[low : low + block, None] + np.arange(window)
            x, y = stream[places], goals[places]
            mixed, q, k, v, a = model.attend(x)
            flat, goal, past = x.ravel(), y.ravel(), mixed.reshape(-1, dim)
            d = p["direct"][flat]
            d += past @ p["out"]
            d -= d.max(axis=1, keepdims=True)
            np.exp(d, out=d)
            live = goal >= 0
            d *= (live / (d.sum(axis=1) * np.float32(live_all))).astype(np.float32)[:, None]
            some = np.flatnonzero(live)
            d[some, goal[some]] -= np.float32(1 / live_all)
            g["out"] += past.T @ d
            dm = (d @ p["out"].T).reshape(mixed.shape)
            ds = np.matmul(dm, v.transpose(0, 2, 1))
            ds -= np.einsum("bij,bij->bi", ds, a)[..., None]
            ds *= a
            g["bias"] += np.bincount(np.maximum(back, 0).ravel(), weights=(ds.sum(0) * (back >= 0)).ravel(), minlength=window).astype(np.float32)
            dv = np.matmul(a.transpose(0, 2, 1), dm).reshape(-1, dim)
            ds *= np.float32(1 / np.sqrt(dim))
            dq, dk = np.matmul(ds, k).reshape(-1, dim), np.matmul(ds.transpose(0, 2, 1), q).reshape(-1, dim)
            # sums by input row: places in order of their rows, and a sum from each row's first
            by = np.argsort(flat, kind="stable")
            sorted_rows = flat[by]
            first = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
            for n, part in (("direct", d), ("v", dv), ("q", dq), ("k", dk)):
                g[n][sorted_rows[first]] += np.add.reduceat(part[by], first, axis=0)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for n in p:
            m1[n] *= np.float32(0.9)
            m1[n] += np.float32(0.1) * g[n]
            m2[n] *= np.float32(0.99)
            g[n] *= g[n]
            m2[n] += np.float32(0.01) * g[n]
            root = np.sqrt(m2[n])
            root *= np.float32(1 / math.sqrt(1 - 0.99**step))
            root += np.float32(1e-7)
            np.divide(m1[n], root, out=root)
            root *= np.float32(rate * (0.1 if n == "direct" else 1.0) / (1 - 0.9**step))
            p[n] -= root
    return model


def train(texts: list[np.ndarray], units: int, end: int, counts: np.ndarray, classes: int = 96, known: int = KNOWN, dim: int = 16, window: int = 32, steps: int = STEPS, seed: int = 3) -> Attention:
    """texts: units, each closed by ``end``; counts: of all units in the training corpus. A model that one learner makes of all it is given."""
    letters = alphabet(counts, end, known)
    return trained(initial(follows(texts, letters), letters, counts, end, classes, dim, window, seed), texts, steps, seed=seed)


def corpus_follows(rows: DataFrame, letters: Alphabet, file: str) -> np.ndarray:
    """follows() of the column __text of all rows; what comes to the driver is bounded by the alphabet."""
    sent, n = rows.sparkSession.sparkContext.broadcast(letters), letters.size

    def run(batches):
        letters, spell = sent.value, speller(file)
        total = np.zeros(n * n, dtype=np.int64)
        for texts in _chunks(batches, 0, 4 * CHUNK):
            s = spelt(texts, spell)
            place = letters.place[s.units]
            before = np.empty(len(place), dtype=np.int64)
            before[1:] = place[:-1]
            before[np.cumsum(s.lengths) - s.lengths] = letters.start
            before *= n
            before += place
            total += np.bincount(before, minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "c"])

    found = rows.select("__text").mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(n * n, dtype=np.int64)
    out[found["at"].to_numpy()] = found["c"].to_numpy()
    return out.reshape(n, n)


def corpus_trained(model: Attention, sample: DataFrame, learners: int, file: str, steps: int) -> Attention:
    """The model trained by learners, each on its part of sample (learner, __text), and averaged by their units, TOGETHER at a time."""
    sent = sample.sparkSession.sparkContext.broadcast(model)
    each = max(1, min(GROUPED, learners // GROUPS))
    schema = pa.schema([("learner", pa.int64()), ("part", pa.int32()), ("units", pa.int64()), ("weights", pa.binary())])

    def learn(rows: pa.Table) -> pa.Table:
        number, total, whole = rows["learner"].to_numpy(), 0, 0.0
        for learner in np.unique(number).tolist():
            texts = sorted(x or b"" for x in rows["__text"].filter(pa.array(number == learner)).to_pylist())
            s = spelt(texts, speller(file))
            found = trained(sent.value, np.split(s.units, np.cumsum(s.lengths)[:-1]), steps, seed=3 + learner)
            whole = whole + np.concatenate([getattr(found, n).ravel() for n in WEIGHTS]).astype(np.float64) * len(s.units)
            total += len(s.units)
        parts = np.array_split((whole / total).astype(np.float32), PARTS)
        return pa.table([pa.array([int(number[0]) // each] * PARTS), pa.array(range(PARTS), pa.int32()), pa.array([total] * PARTS), pa.array([x.tobytes() for x in parts])], schema=schema)

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("learner")
        n = rows["units"].to_numpy().astype(np.float64)
        x = np.stack([np.frombuffer(w.as_py(), dtype=np.float32) for w in rows["weights"]])
        out = (x * (n / n.sum())[:, None]).sum(axis=0).astype(np.float32)
        return pa.table([pa.array([rows["learner"][0].as_py() // TOGETHER]), pa.array([rows["part"][0].as_py()], pa.int32()), pa.array([int(n.sum())]), pa.array([out.tobytes()])], schema=schema)

    kind = "learner long, part int, units long, weights binary"
    level, left = sample.groupBy(F.floor(F.col("learner") / each)).applyInArrow(learn, kind), -(-learners // each)
    while left > 1:
        level = materialize(level.groupBy("part", F.floor(F.col("learner") / TOGETHER)).applyInArrow(mean, kind))
        left = -(-left // TOGETHER)
    parts = {r["part"]: bytes(r["weights"]) for r in level.collect()}
    if not parts:
        return model
    whole, at, out = np.frombuffer(b"".join(parts[i] for i in range(PARTS)), dtype=np.float32), 0, {}
    for n in WEIGHTS:
        size = getattr(model, n).size
        out[n] = whole[at : at + size].reshape(getattr(model, n).shape).copy()
        at += size
    return replace(model, **out)


def _chunks(batches, column: int, size: int):
    """Lists of texts (null: empty) of about size bytes."""
    for batch in batches:
        texts, held = [], 0
        for x in batch.column(column):
            texts.append(x.as_py() or b"")
            held += len(texts[-1])
            if held >= size:
                yield texts
                texts, held = [], 0
        if texts:
            yield texts


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the column __text; the empty word stands for a text's end."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), type=pa.binary()), pa.array(list(counts.values()), type=pa.int64())], ["word", "c"])
            counts.clear()
            return batch

        for batch in batches:
            for x in batch.column(0):
                counts.update((x.as_py() or b"").lower().split())
                counts[b""] += 1
                if len(counts) >= COUNTED:
                    yield out()
        yield out()

    return rows.select("__text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def unit_counts(counts: DataFrame, file: str) -> np.ndarray:
    """Of each unit over the training corpus: how often it occurs, how many tokens and how many distinct tokens begin with it.

    From the words' counts; a row for each unit at most comes to the driver.
    """

    def run(batches):
        spell = speller(file)
        total = np.zeros((3, spell.units), dtype=np.int64)
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.array([spell.end], dtype="<i4").tobytes()
            spelt = iter(spell._encode([w for w in words if w]))
            units = [np.frombuffer(next(spelt) if w else ends, dtype="<i4") for w in words]
            if units:
                first = np.array([u[0] for u in units])
                np.add.at(total[0], np.concatenate(units), np.repeat(c, [len(u) for u in units]))
                np.add.at(total[1], first, c)
                np.add.at(total[2], first, 1)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (some, *total[:, some])], ["unit", "a", "b", "c"])

    found = counts.mapInArrow(run, "unit long, a long, b long, c long").groupBy("unit").agg(F.sum("a"), F.sum("b"), F.sum("c")).collect()
    total = np.zeros((3, speller(file).units), dtype=np.int64)
    for unit, *x in found:
        total[:, unit] = x
    return total


@dataclass
class Spelt:
    """Texts, each a row of tokens (its words and its end), with the units of all tokens one after another."""

    words: list[bytes]  # distinct ones
    token: np.ndarray  # the number of each token's word, len(words) at an end
    ends: np.ndarray  # after each text's last token
    units: np.ndarray
    lengths: np.ndarray  # each text's number of units
    starts: np.ndarray  # each token's first place


def spelt(texts: list[bytes], spell: Speller) -> Spelt:
    found, of = split_words(pa.array(texts, type=pa.binary()).view(pa.string()))
    words = found.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(np.bincount(of, minlength=len(texts)) + 1)
    token = np.full(ends[-1] if len(texts) else 0, len(words), dtype=np.int64)
    inner = np.ones(len(token), dtype=bool)
    inner[ends - 1] = False
    token[inner] = found.indices.to_numpy()
    units, counts = vocab.joined([*spell.cache.values(words), np.array([spell.end], dtype="<i4").tobytes()], token)
    after = np.cumsum(counts)
    return Spelt(words, token, ends, units.astype(np.int64), np.diff(after[ends - 1], prepend=0), after - counts)


def _spelt(texts: list[bytes], spell: Speller) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; units of all texts, each closed by the end; the texts' numbers of units; and each token's first place (the ends' too)."""
    s = spelt(texts, spell)
    split = [[s.words[i] for i in s.token[low : high - 1]] for low, high in zip([0, *s.ends.tolist()], s.ends.tolist())]
    return split, s.units, s.lengths, s.starts


@dataclass
class Scorer:
    """P(w) = rate * c + rest for each token."""

    model: Attention
    tokens: np.ndarray  # C_k
    types: np.ndarray  # V_k
    mixing: float

    def logs(self, units: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of texts one after another: class of the first unit, and logs of its and of the spelling's probability."""
        kinds, whole = self.model.flat(units, lengths)
        first = kinds[starts].astype(np.float64)
        return self.model.kind[units[starts]], first, np.add.reduceat(whole.astype(np.float64), starts) - first

    def mixture(self, k: np.ndarray, first: np.ndarray, spelt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rate, own and new, of which P(w) = (1 - m) * (rate * c + own) + m * new."""
        new, first, size = np.exp(spelt + first), np.exp(first), np.maximum(1, self.tokens[k] + self.types[k])
        return first / size, new * np.where(self.tokens[k] > 0, self.types[k] / size, 1.0), new

    def parts(self, k: np.ndarray, first: np.ndarray, spelt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rate, own, new = self.mixture(k, first, spelt)
        return (1 - self.mixing) * rate, (1 - self.mixing) * own + self.mixing * new


#: A block of texts: sums over the tokens whose counts were broadcast, and of the others the class, the logs and the word's number. Words are in order of their shares of the table of counts.
_BLOCK = (
    "block long, doc_id array<{}>, held_out array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, mixed array<double>, left array<double>, "
    "rare array<int>, kind array<smallint>, first array<float>, rest array<double>, word array<int>, share array<bigint>, n_words array<int>, words array<binary>"
)
_FOUND = "doc_id {}, held_out boolean, n_tokens long, n_known long, base_score double, mixed array<double>, left array<double>"


def _logs(rate: np.ndarray, own: np.ndarray, new: np.ndarray, c: np.ndarray, mixing: tuple[float, ...]) -> list[np.ndarray]:
    """log10 of tokens' probabilities under each value of m, from counts, and with the token itself left out."""
    return [np.log10((1 - m) * (rate * x + own) + m * new + 1e-300) for x in (c, np.maximum(c - 1, 0)) for m in mixing]


def _scored(context, file: str, n: int, v: int, shares: int):
    def scored(texts: list[bytes]) -> tuple:
        known, scorer, mixing = context.value
        s = spelt(texts, speller(file))
        k, first, rest = scorer.logs(s.units, s.lengths, s.starts)
        c = np.array([*[known.get(w, -1) for w in s.words], known[b""]], dtype=np.float64)[s.token]
        here = c >= 0
        c = np.maximum(c, 0)
        begins = np.concatenate([[0], s.ends[:-1]])
        sums = lambda x: np.add.reduceat(np.where(here, x, 0), begins)
        logs = np.stack([sums(x) for x in _logs(*scorer.mixture(k, first, rest), c, mixing)], axis=1)
        away = ~here
        number, of = np.unique(s.token[away], return_inverse=True)
        return (
            np.diff(s.ends, prepend=0), sums(c > 0), sums(np.log10((c + 1) / (n + v + 1))), logs[:, : len(mixing)].ravel(), logs[:, len(mixing) :].ravel(),
            np.add.reduceat(away.astype(np.int64), begins), k[away], first[away], rest[away], of, [s.words[i] for i in number.tolist()],
        )

    def block(number: int, batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
        places: dict[bytes, int] = {}
        word = np.concatenate([np.array([places.setdefault(w, len(places)) for w in p[-1]], dtype=np.int64)[p[-2]] for p in parts])
        words, share = list(places), np.array([zlib.crc32(w) for w in places], dtype=np.int64) % shares
        order = np.argsort(share, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        used, begins, sizes = np.unique(share[order], return_index=True, return_counts=True)
        joined = [b" ".join([words[i] for i in order[low : low + size]]) for low, size in zip(begins, sizes)]
        flat = [np.concatenate(x) for x in list(zip(*parts))[:-2]] + [place[word], used, sizes]
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int32(), pa.int16(), pa.float32(), pa.float64(), pa.int32(), pa.int64(), pa.int32()]
        lists = [batch.column(0), batch.column(1), *[pa.array(x.astype(t.to_pandas_dtype()), type=t) for x, t in zip(flat, kinds)], pa.array(joined, type=pa.binary())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], type=pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays([pa.array([number]), *lists], [x.split()[0] for x in _BLOCK.split(", ")])

    def run(batches):
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            low, high, parts = 0, 0, []
            for texts in _chunks([batch], 2, CHUNK):
                parts.append(scored(texts))
                high += len(texts)
                if high == len(batch) or sum(len(p[-2]) for p in parts) >= BLOCK:
                    yield block(made, batch.slice(low, high - low), parts)
                    low, parts, made = high, [], made + 1

    return run


def _answered(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """The counts of each block's words that lie in a share of the table of counts (0 of words that it lacks)."""
    words = [x.as_py().split(b" ") for x in asked["words"]]
    at = pc.index_in(pa.array([w for x in words for w in x], type=pa.binary()), value_set=counted["word"].combine_chunks())
    c = pc.fill_null(counted["c"].combine_chunks().take(at), 0)
    c = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]), type=pa.int32()), c)
    return pa.table([asked["block"], asked["share"], c], names=["block", "share", "c"])


def _completed(context, n: int, v: int):
    def completed(done: pa.Table, answers: pa.Table) -> pa.Table:
        """The rows of a block, with the tokens whose counts were asked for."""
        _, scorer, mixing = context.value
        doc_id, held_out, *lists = (done[x].combine_chunks().flatten() for x in done.column_names[1:])
        n_tokens, n_known, base, mixed, left, rare, kind, first, rest, word, share, n_words = (x.to_numpy() for x in lists)
        begins = dict(zip(share.tolist(), (np.cumsum(n_words) - n_words).tolist()))
        c = np.zeros(n_words.sum(), dtype=np.float64)
        for of, x in zip(answers["share"].to_pylist(), answers["c"]):
            c[begins[of] : begins[of] + len(x)] = x.values.to_numpy()
        c = c[word]
        of = np.repeat(np.arange(len(rare)), rare)
        sums = lambda x: np.bincount(of, weights=x, minlength=len(rare))
        logs = np.stack([sums(x) for x in _logs(*scorer.mixture(kind, first.astype(np.float64), rest), c, mixing)], axis=1)
        m = len(mixing)
        ends = pa.array(np.arange(len(rare) + 1) * m, type=pa.int32())
        many = [pa.ListArray.from_arrays(ends, pa.array(x + logs[:, part].ravel())) for x, part in ((mixed, slice(m)), (left, slice(m, None)))]
        known = n_known + sums(c > 0).astype(np.int64)
        return pa.table([doc_id, held_out, n_tokens, known, base + sums(np.log10((c + 1) / (n + v + 1))), *many], names=[x.split()[0] for x in _FOUND.split(", ")])

    return completed


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_file: str | None = None, common: int = COMMON, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for each row of docs.

    Tokens are the text's words with A-Z lower-cased and one end; null texts count as empty. The training rows are
    those not held out (crc32 of doc_id as text, modulo 7, is not 2; a null doc_id counts as an empty string).
    Repeated rows are scored alike and learnt from each (equal ones by the same learner); very long texts are scored whole, in windows; without training rows
    all counts are 0 and the model is untrained; an empty table gives an empty table; other columns are ignored.
    """
    file = byte_file or vocab.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (fold == HELD_OUT).alias("held_out"), text_bytes(f"`{text}`").alias("__text"))
    counts = materialize(word_counts(rows.where(~F.col("held_out"))))
    n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    # the least count that at most common words reach, on a scale of sixteenths of a doubling
    scale = F.floor(16 * F.log2("c")).cast("int")
    sizes = sorted(((r["s"], r["count"]) for r in counts.groupBy(scale.alias("s")).count().collect()), reverse=True)
    reached = [s for (s, _), total in zip(sizes, np.cumsum([c for _, c in sizes])) if total <= common]
    known = {bytes(r["word"]): r["c"] for r in counts.where(scale >= reached[-1]).collect()} if reached else {}
    ends = counts.where(F.length("word") == 0).select("c").first()
    known[b""] = ends["c"] if ends else 0
    train_rows = known[b""]
    totals, end = unit_counts(counts, file), speller(file).end
    letters = alphabet(totals[0], end)
    training = rows.where(~F.col("held_out"))
    model = initial(corpus_follows(training, letters, file), letters, totals[0], end)
    train_bytes = int(counts.agg(F.sum(F.col("c") * (F.length("word") + 1))).first()[0] or 0)
    learners = max(1, math.ceil(train_rows / LEARNER_ROWS), math.ceil(train_bytes / LEARNER_BYTES))
    # by a row's place in the scan too, so that no learner gets all of equal rows
    at = F.xxhash64(F.lit(8), "doc_id", "__text", F.monotonically_increasing_id())
    sample = training.select(F.pmod(at, F.lit(learners)).alias("learner"), "__text")
    model = corpus_trained(model, sample, learners, file, steps) if steps else model
    scorer = Scorer(model, *(np.bincount(model.kind, weights=x) for x in totals[1:]), 0.5)
    context = spark.sparkContext.broadcast((known, scorer, MIXING))
    shares = max(1, math.ceil((rows.agg(F.sum(F.length("__text"))).first()[0] or 0) / SHARED))
    kind = rows.schema["doc_id"].dataType.simpleString()
    done = materialize(rows.mapInArrow(_scored(context, file, n, v, shares), _BLOCK.format(kind)), **LONG_ROWS)
    asked = done.select("block", F.inline(F.arrays_zip("share", "words")))
    shared = counts.select((F.crc32("word") % shares).alias("share"), "word", "c")
    answers = asked.groupBy("share").cogroup(shared.groupBy("share")).applyInArrow(_answered, "block long, share long, c array<bigint>")
    found = done.drop("words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_completed(context, n, v), _FOUND.format(kind))
    found = materialize(found)
    # m: of most leave-one-out likelihood of all training rows
    total = found.where(~F.col("held_out")).agg(*[F.sum(F.col("left")[i]) for i in range(len(MIXING))]).first()
    best = max(range(len(MIXING)), key=lambda i: total[i] or 0.0)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", F.col("mixed")[best].alias("score"))
