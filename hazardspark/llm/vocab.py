"""Public tokenizers applied word by word, with bounded caches.

The vocabularies used here never join characters across white space, so the ids of a text are the
ids of its words one after another, and a cache from word to ids replaces most calls of the
libraries. A cache stops growing at ``limit`` words; later words are encoded again where they occur.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

from hazardspark.llm.common import split_words

#: Words that a cache keeps.
CACHE_WORDS = 300_000


def path(name: str, folder: str | None = None) -> str:
    """A vocabulary's file: in folder, or where the installed package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache:
    """Word (bytes) to value by encode(list of words) -> list of values, for whole groups of texts."""

    def __init__(self, encode: Callable[[list[bytes]], list], limit: int = CACHE_WORDS):
        self.encode, self.limit, self.known = encode, limit, {}

    def extend(self, words: Iterable[bytes]) -> list[bytes]:
        """Make values of all words known; returns those to forget() afterwards."""
        known = self.known
        new = list(set(words).difference(known))
        if not new:
            return []
        room = self.limit - len(known)
        known.update(zip(new, self.encode(new)))
        return new[max(0, room):]

    def forget(self, words: list[bytes]) -> None:
        for w in words:
            del self.known[w]

    def values(self, words: list[bytes]) -> list:
        late = self.extend(words)
        out = list(map(self.known.__getitem__, words))
        self.forget(late)
        return out


def joined(parts: list[bytes], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (4 bytes each) of the parts of these numbers one after another, and how many each has."""
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
    counts = sizes[numbers]
    after = np.cumsum(counts)
    places = np.repeat((np.cumsum(sizes) - sizes)[numbers] - (after - counts), counts)
    places += np.arange(len(places))
    return np.frombuffer(b"".join(parts), dtype="<u4")[places], counts


#: Words whose characters NFC and lower-casing treat one by one; the others take the library's own path.
_PLAIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Words of lower-case letters of that range.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The vocabulary's split of such words (fixed values of its file).
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class WordBpe:
    """word_bpe_49k.json: ids of lower-case texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, file: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            data = json.load(f)
        self.full = Tokenizer.from_str(json.dumps(data))
        by_space = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        to_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare = {**data, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [by_space, to_bytes]}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        vocabulary = data["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache = Cache(self._encode, limit)

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        plain, split, counts = [], [], []
        for i, w in enumerate(words):
            if _LETTERS.fullmatch(w):  # one part, lower-case as it is
                plain.append(i)
                split.append(w)
                counts.append(1)
                continue
            s = w.decode("utf-8", "replace")
            if _PLAIN.fullmatch(s):
                parts = _SPLIT.findall(s.lower())
                plain.append(i)
                split.append(" ".join(parts).encode())
                counts.append(len(parts))
            else:
                out[i] = self._whole(s)
        groups = [slice(at, at + 256) for at in range(0, len(plain), 256)]
        for low in range(0, len(groups), 16):
            some = groups[low : low + 16]
            for group, found in zip(some, self.bare.encode_batch_fast([b" ".join(split[g]).decode() for g in some], add_special_tokens=False)):
                ids = np.array(found.ids, dtype="<u4")
                cuts = 4 * (np.flatnonzero(self.ends[ids])[np.cumsum(counts[group]) - 1] + 1)
                whole, at = ids.tobytes(), 0
                for i, cut in zip(plain[group], cuts.tolist()):
                    out[i] = whole[at:cut]
                    at = cut
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, special tokens' strings included as the library finds them."""
        special = [b"<|" in t for t in texts]
        words, of = split_words(pa.array([b"" if odd else t for t, odd in zip(texts, special)], type=pa.binary()).view(pa.string()))
        found, counts = joined(self.cache.values(words.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()), words.indices.to_numpy())
        ends = 4 * np.cumsum(np.bincount(of, weights=counts, minlength=len(texts)).astype(np.int64))
        whole, low, out = found.tobytes(), 0, []
        for t, odd, high in zip(texts, special, ends.tolist()):
            out.append(self._whole(t.decode("utf-8", "replace")) if odd else whole[low:high])
            low = high
        return out


@functools.cache
def word_bpe(file: str) -> WordBpe:
    """One a worker process, kept from task to task."""
    return WordBpe(file)


@functools.cache
def byte_bpe(file: str):
    import public_tokenizers
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def pieces(file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=file)
