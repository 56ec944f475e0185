"""Words of many texts at once: where they are and a 64-bit hash of each, in numpy."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tandem.llm.common import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 18
_ODD = [np.uint64(int(x) | 1) for x in np.random.RandomState(5).randint(1 << 30, 1 << 62, 64, dtype=np.int64)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def alphabet(separators: bytes) -> np.ndarray:
    """A table of bytes that lower-cases A-Z and sends ``separators`` to 0."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words of letters and digits, ASCII or not: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = alphabet(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Words between white space: [^\x20\x09-\x0D]+ after lower-casing A-Z.
SPACED = alphabet(b" \t\n\v\f\r")


@dataclass
class Words:
    """``counts``: words of each text; the rest has an entry for each word."""
    counts: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """The index of each text's first word."""
        return np.cumsum(self.counts) - self.counts


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 12, 1 << int(n).bit_length())
    if size not in _POWERS:
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _POWERS.clear()
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[start:end]`` for ascending, disjoint spans of whole numbers that are never 0."""
    out, i, n = np.empty(len(start), np.uint64), 0, len(start)
    while i < n:
        base = start[i]
        j = max(int(np.searchsorted(end, base + _BLOCK, "right")), i + 1)
        part = data[base:end[j - 1]].astype(np.uint64)
        power, inverse = _powers(len(part))
        part *= power[:len(part)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """The words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    low = table[data]
    inside = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    after[-1:], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(np.bincount(doc, minlength=len(offsets) - 1), doc, start, end, span_hashes(low, start, end))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words within a text, and the index of each run's first word."""
    if len(w.hash) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(w.doc[: len(w.doc) - n + 1] == w.doc[n - 1:])
    total = np.zeros(len(w.hash) - n + 1, np.uint64)
    for j in range(n):
        total += w.hash[j: len(w.hash) - n + 1 + j] * _ODD[j % 64] + np.uint64(j)
    return mix(total[at]), at
