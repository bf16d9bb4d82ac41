import inspect
import math
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

from hazardspark.llm import lm, vocab
from tests.llm import data

FILE = vocab.path("byte_bpe_50k.tiktoken")


def test_units_are_scored_with_a_quarter_window_before_them():
    texts = [np.random.default_rng(k).integers(0, 40, 300) for k in range(20)]
    model = lm.train(texts, 50, 49, np.bincount(np.concatenate(texts), minlength=50), classes=12, steps=3)
    at = 160  # a change is seen for at least a quarter window, wherever windows begin
    for place in range(at, at + model.window):
        changed = texts[0].copy()
        changed[place] = (changed[place] + 7) % 40
        a, b = (model.log_probs([t])[0][0] for t in (texts[0], changed))
        assert (a[place + 1 : place + 9] != b[place + 1 : place + 9]).sum() >= 6


def test_classes():
    assert inspect.signature(lm.train).parameters["classes"].default == 96


def small(steps=30):
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(0, 39, n), 39) for n in (1, 5, 7, 8, 9, 30, 61, 200)]
    return lm.train(texts, 40, 39, np.bincount(np.concatenate(texts), minlength=40), classes=12, known=20, dim=4, window=8, steps=steps), texts


def test_windows_against_attention_place_by_place():
    model, texts = small()
    overlap, start = model.window - model.stride, len(model.direct) - 1
    for text, got in zip(texts, model.log_probs(texts)[0]):
        inputs = np.concatenate([[start], model.row[text[:-1]]])
        for t in range(len(text)):
            begin = 0 if t < overlap else (t - overlap) // model.stride * model.stride
            past = inputs[begin : t + 1]
            a = np.array([model.q[inputs[t]] @ model.k[x] / 2 + model.bias[len(past) - 1 - i] for i, x in enumerate(past)], dtype=np.float64)
            mixed = np.exp(a - a.max()) / np.exp(a - a.max()).sum() @ model.v[past]
            logits = model.direct[inputs[t]] + mixed @ model.out
            want = logits[model.kind[text[t]]] - math.log(np.exp(logits).sum())
            assert abs(got[t] - want) < 1e-4


def test_a_unit_is_scored_in_one_window_like_the_whole_text_if_it_is_short():
    model, texts = small()
    for t in texts[:4]:  # no longer than a window: each place sees all that is before it
        first = model.log_probs([t])[0][0]
        longer = model.log_probs([np.append(t[:-1], [1, 2, 3])])[0][0]
        assert np.allclose(first[:-1], longer[: len(t) - 1], atol=1e-5)


def test_probabilities_of_words_sum_to_one():
    model, texts = small()
    counts = np.bincount(np.concatenate(texts), minlength=40)  # each unit is a word here
    scorer = lm.Scorer(model, np.bincount(model.kind, weights=counts), np.bincount(model.kind, weights=counts > 0), 0.3)
    past = texts[-1][:11]
    total = 0.0
    for u in range(40):
        rate, rest = scorer.parts(*scorer.logs(np.append(past, u), np.array([12]), np.arange(12)))
        total += rate[-1] * counts[u] + rest[-1]
    assert 1 - 1e-3 < total < 1 + 1e-5  # classes that no unit is in keep a little


def test_follows_are_counted_over_all_rows(spark):
    rows = data.documents("sf0.01", 300)
    df = data.frame(spark, rows).repartition(7).select(F.col("text").cast("binary").alias("__text"))
    _, units, lengths, _ = lm._spelt([r[1].encode() for r in rows], lm.speller(FILE))
    end = lm.speller(FILE).end
    letters = lm.alphabet(np.bincount(units, minlength=end + 1), end, 50)
    got = lm.corpus_follows(df, letters, FILE)
    texts = np.split(units, np.cumsum(lengths)[:-1])
    assert (got == lm.follows(texts, letters)).all() and got.sum() == len(units)
    assert got[letters.start].sum() == len(rows) and got[:, letters.size - 2].sum() == len(rows)


def test_learners_are_averaged(spark):
    rows = data.documents("sf0.01", 200)
    _, units, lengths, _ = lm._spelt([r[1].encode() for r in rows], lm.speller(FILE))
    end = lm.speller(FILE).end
    counts = np.bincount(units, minlength=end + 1)
    texts = np.split(units, np.cumsum(lengths)[:-1])
    letters = lm.alphabet(counts, end, 200)
    model = lm.initial(lm.follows(texts, letters), letters, counts, end, classes=24, dim=4)
    df = data.frame(spark, rows).select((F.col("doc_id") % 3).alias("learner"), F.col("text").cast("binary").alias("__text"))
    got = lm.corpus_trained(model, df, 3, FILE, 40)
    parts = []
    for k in range(3):
        mine = sorted(r[1].encode() for r in rows if r[0] % 3 == k)
        _, u, n, _ = lm._spelt(mine, lm.speller(FILE))
        parts.append((len(u), lm.trained(model, np.split(u, np.cumsum(n)[:-1]), 40, seed=3 + k)))
    for name in lm.WEIGHTS:
        want = sum(n * getattr(m, name) for n, m in parts) / sum(n for n, _ in parts)
        assert np.allclose(getattr(got, name), want, atol=1e-5)
    assert all((getattr(model, n) != getattr(got, n)).any() for n in ("q", "out"))


def test_spelt_places():
    split, units, lengths, starts = lm._spelt([b"Abc  def", b"", b"x"], lm.speller(FILE))
    end = lm.speller(FILE).end
    assert split == [[b"abc", b"def"], [], [b"x"]] and lengths.sum() == len(units) and len(starts) == 6
    assert [int(units[s]) == end for s in starts] == [False, False, True, True, False, True] and (units[np.cumsum(lengths) - 1] == end).all()


def test_small_logits_are_no_zero_rows():
    rng = np.random.default_rng(1)
    model = lm.Attention(
        *(None,) * 3, q=rng.normal(size=(5, 4)).astype(np.float32) * 1e3, k=-np.abs(rng.normal(size=(5, 4))).astype(np.float32) * 1e3, v=rng.normal(size=(5, 4)).astype(np.float32),
        bias=np.full(8, -500, dtype=np.float32), direct=np.zeros((5, 3)), out=np.zeros((4, 3)), window=8,
    )
    out = model.attend(rng.integers(0, 5, (2, 8)))
    assert np.isfinite(out[0]).all() and np.allclose(out[-1].sum(axis=-1), 1, atol=1e-5)
    assert np.allclose(np.triu(out[-1][0], 1), 0)


def test_a_learner_learns_from_all_its_units():
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(0, 39, 300), 39) for _ in range(10)]
    counts = np.bincount(np.concatenate(texts), minlength=40)
    letters = lm.alphabet(counts, 39, 38)
    model = lm.initial(lm.follows(texts, letters), letters, counts, 39, classes=12, dim=4, window=8)
    rare = np.append(np.full(30, letters.known[-1]), 39)  # few windows of very many hold it
    got = lm.trained(model, [*texts, rare], steps=1, batch=2)
    seen = np.unique(np.concatenate([model.row[t] for t in [*texts, rare]]))
    assert (got.v[seen] != model.v[seen]).any(axis=1).all()
    short = lm.trained(model, [rare[-2:]], steps=1)  # less than a window
    assert (short.out != model.out).any()


def test_all_training_rows_train(spark, monkeypatch):
    rows = [(i, f"word{i % 50} and word{i % 7} of {i % 11}") for i in range(2600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = []
    monkeypatch.setattr(lm, "corpus_trained", lambda model, sample, *rest: sizes.append(sample.count()) or model)
    trained_on = lm.score(df).where("not held_out").count()
    assert sizes == [trained_on] and trained_on > 2000


def test_joined_words_are_spelt_as_each_alone():
    spell = lm.speller(FILE)
    words = sorted({w for r in data.documents("sf0.01", 300) for w in r[1].encode().lower().split()}) + [b"\xff\xfea", b"'s", b"don't", b"'", b"123abc", b"...", b"a\x1cb", "a\u00a0".encode(), "\u00d7\u00e9".encode()]
    alone = [np.array(spell.bpe.encode_ordinary(" " + w.decode("utf-8", "replace"))) * 2 for w in words]
    got = [np.frombuffer(u, dtype="<i4") for u in spell._encode(words)]
    assert all((a[:-1] == g[:-1]).all() and a[-1] + 1 == g[-1] and len(a) == len(g) for a, g in zip(alone, got))


def test_the_mixing_weight_is_best_over_all_training_rows(spark, monkeypatch):
    # the first rows of any order by hash are few of these; words of most rows occur once, so left-one-out likelihood wants much spelling
    rows = [(i, f"odd{i}x{i * 7} word") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(df, steps=0).collect()}
    monkeypatch.setattr(lm, "MIXING", (0.4,))
    alone = {r.doc_id: r.score for r in lm.score(df, steps=0).collect()}
    assert all(math.isclose(got[d], alone[d], rel_tol=1e-9) for d in got)


def scratch_files(monkeypatch):
    """What materialize() writes for lm: (schema, bytes of the files), table by table."""
    written, write = [], lm.materialize

    def materialize(df, *args, **options):
        df = write(df, *args, **options)
        written.append((df.columns, sum(Path(urlparse(f).path).stat().st_size for f in df.inputFiles())))
        return df

    monkeypatch.setattr(lm, "materialize", materialize)
    return written


def test_scratch_of_words_that_are_not_broadcast(spark, monkeypatch):
    rows = data.documents("sf0.01", 500)
    df = data.frame(spark, rows).coalesce(2)
    written = scratch_files(monkeypatch)
    tokens = lm.score(df, common=0, steps=0).agg(F.sum("n_tokens")).first()[0]
    assert sum(size for _, size in written) < 18 * tokens  # every word is asked for; numbers alone were 24 bytes a token


def test_words_are_asked_for_in_any_blocks_and_shares(spark, monkeypatch):
    rows = data.documents("sf0.01", 300) + [(None, "two words", "en", "b", 1), (-1, None, "en", "b", 1), (-2, "once " * 50 + "unseen\u00e9word", "en", "b", 1)]
    df = data.frame(spark, rows).coalesce(2)
    all_here = sorted(map(tuple, lm.score(df, steps=0).collect()), key=str)
    monkeypatch.setattr(lm, "BLOCK", 1000)
    monkeypatch.setattr(lm, "CHUNK", 5000)
    monkeypatch.setattr(lm, "SHARED", 20_000)
    none_here = sorted(map(tuple, lm.score(df, common=0, steps=0).collect()), key=str)
    assert len(all_here) == len(none_here) == len(rows)
    for a, b in zip(all_here, none_here):
        assert a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a[5:], b[5:]))


def test_many_learners_are_averaged_in_groups_and_their_weights_not_written_singly(spark, monkeypatch):
    rows = data.documents("sf0.01", 100)
    _, units, lengths, _ = lm._spelt([r[1].encode() for r in rows], lm.speller(FILE))
    end = lm.speller(FILE).end
    counts = np.bincount(units, minlength=end + 1)
    letters = lm.alphabet(counts, end, 200)
    model = lm.initial(lm.follows(np.split(units, np.cumsum(lengths)[:-1]), letters), letters, counts, end, classes=24, dim=4)
    df = data.frame(spark, rows).select((F.col("doc_id") % 5).alias("learner"), F.col("text").cast("binary").alias("__text"))
    alone = lm.corpus_trained(model, df, 5, FILE, 10)
    monkeypatch.setattr(lm, "GROUPED", 2, raising=False)
    monkeypatch.setattr(lm, "GROUPS", 1, raising=False)
    written = scratch_files(monkeypatch)
    got = lm.corpus_trained(model, df, 5, FILE, 10)
    assert all(np.allclose(getattr(got, n), getattr(alone, n), atol=1e-6) for n in lm.WEIGHTS)
    size = sum(getattr(model, n).nbytes for n in lm.WEIGHTS)
    assert len(written) == 1 and written[0][1] < 1.5 * size
