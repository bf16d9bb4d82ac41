import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from hazardspark.llm import pack, vocab
from tests.llm import data

FILE = vocab.path("word_bpe_49k.json")


def check(rows, texts, length=2048):
    """rows: pieces; texts: of all documents, by doc_id a list."""
    tokenizer = Tokenizer.from_file(FILE)
    want = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for ts in texts.values() for t in ts)
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length * 4 == len(r.ids) and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    got = []
    for rs in by.values():  # a document's pieces follow each other; equal documents' pieces may be cut apart at other places
        while rs:
            ids, n = b"", None
            while n is None or len(ids) < 4 * n:
                want_ids = [w for w in want if w.startswith(ids)]
                r = next(r for r in rs if r.start * 4 == len(ids) and r.doc_tokens == (n or r.doc_tokens) and any(w[len(ids) :].startswith(bytes(r.ids)) and len(w) == 4 * r.doc_tokens for w in want_ids))
                rs.remove(r)
                ids, n = ids + bytes(r.ids), r.doc_tokens
            got.append(ids)
    assert sorted(got) == want
    fills = []
    for rs in sequences.values():
        rs = sorted(rs, key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
        fills.append(sum(r.length for r in rs))
        assert fills[-1] <= length
    return fills


def test_round_trip_and_little_padding(spark):
    rows = data.documents("sf0.01")
    fills = check(pack.pack(data.frame(spark, rows)).collect(), {r[0]: [r[1]] for r in rows})
    assert sum(2048 - f for f in fills) / (2048 * len(fills)) < 0.02


@pytest.mark.parametrize("windows,tasks", [(2, 40), (64, 3)])
def test_many_tasks_merge_their_leftovers(spark, windows, tasks):
    rows = data.documents("sf0.01", 400)
    df = data.frame(spark, rows).repartition(tasks)
    fills = check(pack.pack(df, windows=windows).collect(), {r[0]: [r[1]] for r in rows})
    assert sum(f < 1900 for f in fills) <= windows


@pytest.mark.parametrize("kind", ["odd", "clashing", "empty"])
def test_edge_tables(spark, kind):
    df = data.edge_tables(spark)[kind]
    texts = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    check(pack.pack(df).collect(), texts)


def test_words_give_the_ids_of_whole_texts():
    words, whole = vocab.word_bpe(FILE), Tokenizer.from_file(FILE)
    texts = ["I'm <|endoftext|> x <|ENDOFTEXT|>", "naïve café ²x½ _a_b 'S don't ǅ İstanbul ΑΣ", "a b\u0085c", "日本語 12ab!?x\x00", "", "é ́x", "it's we'll _x_ 3rd #*$%&|<>"]
    texts += [t for _, t, *_ in data.documents()]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert words.ids([t.encode() for t in texts]) == want
    small = vocab.WordBpe(FILE, limit=10)  # a full cache changes nothing
    assert small.ids([t.encode() for t in texts]) == want and len(small.cache.known) <= 10


def test_a_chunks_words_are_looked_up_once_each(monkeypatch):
    words = vocab.WordBpe(vocab.path("word_bpe_49k.json"))
    seen, values = [], words.cache.values
    monkeypatch.setattr(words.cache, "values", lambda ws: seen.append(len(ws)) or values(ws))
    texts = [b"One two  two don't", b"", b"two \xc3\x9cber \xc3\xbcber", b"x <|endoftext|> y", b"a\x1cb\xe2\x80\xa8c \xff"]
    got = words.ids(texts)
    assert seen == [7]  # one, two, don't, both forms of ueber, and the two odd words of the last text
    assert got == [words._whole(t.decode("utf-8", "replace")) for t in texts]
