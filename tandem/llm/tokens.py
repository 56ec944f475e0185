"""Token ids of many texts at once, as a given tokenizer file makes them.

A byte-level tokenizer first cuts a text into words by a fixed rule and then codes each
word by itself. Words repeat, so they are cut and compared in numpy and only words that
the worker has not met yet are handed to the tokenizer.
"""
from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tandem.llm.words import span_hashes

#: The cutting rule that is followed here (a fixed value of the tokenizer's format):
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters with the property White_Space (fixed values).
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    kind = {"L": _LETTER, "N": _NUMBER}
    for c in range(0x110000):
        out[c] = kind.get(unicodedata.category(chr(c))[0], _OTHER)
    out[_SPACES] = _SPACE
    return out


def word_bounds(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words start in the code points of texts that lie end to end at ``offsets``."""
    n = len(chars)
    kind = _classes()[chars]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= edge[:n]
    space = kind == _SPACE
    # The last blank before something else is a word of its own, or the head of what follows if it is a plain space.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~edge[1:n + 1]
    follow = np.flatnonzero(last) + 1
    start[follow - 1] = True
    start[follow[chars[follow - 1] == 0x20]] = False
    # An apostrophe that starts a word takes a short ending with it.
    for i in np.flatnonzero((chars == 0x27) & start):
        if i + 1 < n and not edge[i + 1] and kind[i + 1] == _LETTER:
            tail = chr(chars[i + 1]) + (chr(chars[i + 2]) if i + 2 < n and not edge[i + 2] else "")
            size = next((len(e) for e in _ENDINGS if tail.startswith(e)), 0)
            if size:
                start[i + 1] = False
                if i + 1 + size < n:
                    start[i + 1 + size] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts by a tokenizers file; remembers up to ``most`` words."""

    def __init__(self, path: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        #: Words can be coded one by one only under the cutting rule above.
        self.by_word = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                        and pre.get("use_regex", True) and not spec.get("normalizer"))
        self.most, self.slots = most, 2 * most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.begin, self.size = np.zeros(self.most, np.int64), np.zeros(self.most, np.int32)
        self.count, self.flat, self.used = 0, np.zeros(2 * self.most, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the table of hashes, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        open_, slot = np.arange(len(hashes)), (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(open_):
            key = self.keys[slot]
            hit = key == hashes[open_]
            out[open_[hit]] = self.at[slot[hit]]
            more = ~hit & (key != 0)
            open_, slot = open_[more], (slot[more] + 1) & (self.slots - 1)
        return out

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Code words that are not in the table, each once."""
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [e.ids for e in coded]
        sizes = np.array([len(x) for x in ids], np.int64)
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
        self.flat[self.used:self.used + total] = [i for x in ids for i in x]
        number = self.count + np.arange(len(ids))
        self.begin[number], self.size[number] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + total, self.count + len(ids)
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        while len(number):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.at[slot[won]] = hashes[won], number[won]
            lost = np.ones(len(number), bool)
            lost[won] = False
            hashes, number, slot = hashes[lost], number[lost], (slot[lost] + 1) & (self.slots - 1)

    def _words(self, hashes: np.ndarray, text: str, start: np.ndarray, end: np.ndarray) -> np.ndarray | None:
        """The number of each word among the known ones; None if there are more new words than the table holds."""
        out = self._find(hashes)
        missed = np.flatnonzero(out < 0)
        if len(missed):
            new, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            if len(new) > self.most:
                return None
            if self.count + len(new) > self.most:
                self._clear()
                return self._words(hashes, text, start, end)
            where = missed[first]
            self._learn(new, [text[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())])
            out[missed] = self._find(new)[back]
        return out

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a binary column of UTF-8."""
        texts = [(b or b"").decode("utf-8", "replace") for b in column.to_pylist()]
        plain = [self.by_word and not any(s in t for s in self.special) for t in texts]
        whole = [t for t, p in zip(texts, plain) if not p]
        direct = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else [])
        parts = iter(self._plain([t for t, p in zip(texts, plain) if p]))
        return [next(parts) if p else np.array(next(direct).ids, np.uint32) for p in plain]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        text = "".join(texts)
        if not text:
            return [np.empty(0, np.uint32) for _ in texts]
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start = word_bounds(chars, offsets)
        end = np.append(start[1:], len(chars))
        hashes = span_hashes(chars + np.uint32(1), start, end)
        hashes[hashes == 0] = 1
        word = self._words(hashes, text, start, end)
        if word is None:
            return [np.array(e.ids, np.uint32)
                    for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = self.size[word].astype(np.int64)
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.begin[word] - (ends - sizes), sizes) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; it lives as long as the worker."""
    return Encoder(path)
