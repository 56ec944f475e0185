"""Personal data: fixed patterns, and a character-level BiLSTM with CRF transitions that adds spans.

The network is trained on the driver in numpy, from a bounded sample of windows that the
patterns labelled, from labelled variants of them (other separators, spelt-out marks)
that no pattern matches, and from look-alikes. Its gates are piecewise linear, in training as in use, so a
character costs no exponential. Windows that overlap are joined by weighted emissions, and tags
are decoded once over the whole stretch they cover.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import as_bytes, mapped, pieces, saved
from tandem.llm.spans import PII, digest, luhn, overlaps, pii_spans, written

#: Characters of a window in training, of one in use, and how many two of those share.
WIDTH, WINDOW, SHARED = 96, 256, 16
TAGS = 1 + 2 * len(PII)  # outside, then begin and inside of each kind
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOLS = 32 + len(_PUNCTUATION)
_HINT = re.compile("[0-9@]")


def symbols(text: str) -> np.ndarray:
    """0 padding, 1 other, 2 blank, 3 line end, 4 digit, 5 to 30 letters, 31 other letters, then punctuation."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = np.ones(128, np.uint8)
    table[[32, 9]], table[[10, 13]], table[48:58] = 2, 3, 4
    table[97:123] = table[65:91] = np.arange(5, 31)
    table[[ord(c) for c in _PUNCTUATION]] = np.arange(32, _SYMBOLS)
    return np.where(codes < 128, table[np.minimum(codes, 127)], np.where(codes < 192, 1, 31)).astype(np.uint8)


def tags(length: int, spans, offset: int = 0) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for a, b, k in spans:
        a, b = a - offset, b - offset
        if 0 <= a and b <= length:
            out[a], out[a + 1:b] = 1 + 2 * k, 2 + 2 * k
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """A bidirectional LSTM over symbols, a linear layer to tag scores, and a CRF.

    Gates are ``clip(z / 4 + 1 / 2, 0, 1)``; the candidate and the cell's output are cut to [-1, 1].
    """

    def __init__(self, hidden: int = 12, width: int = 6, seed: int = 7):
        r, h = np.random.RandomState(seed), hidden
        self.p = {"emb": r.randn(_SYMBOLS, width) * 0.5, "wx": r.randn(2, width, 4 * h) * 0.5, "b": np.zeros((2, 4 * h)),
                  "wh": r.randn(2, h, 4 * h) * 0.3, "wo": r.randn(2 * h, TAGS) * 0.3, "bo": np.zeros(TAGS),
                  "trans": np.zeros((TAGS, TAGS))}
        self.p["b"][:, h:2 * h] += 1.0  # remember at first
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.h = hidden

    def _run(self, ids: np.ndarray, d: int, keep: bool = False):
        """Hidden states of one direction [T, B, h]; with ``keep`` also what the gradient needs."""
        h, wh = self.h, self.p["wh"][d]
        pre = (self.p["emb"] @ self.p["wx"][d] + self.p["b"][d])[ids.T[::-1] if d else ids.T]
        state, cell = np.zeros((len(ids), h), pre.dtype), np.zeros((len(ids), h), pre.dtype)
        out, kept = np.empty((ids.shape[1], len(ids), h), pre.dtype), []
        for t in range(ids.shape[1]):
            z = pre[t] + state @ wh
            gates = np.clip(0.25 * z[:, :3 * h] + 0.5, 0, 1)
            new = np.clip(z[:, 3 * h:], -1, 1)
            before, cell = cell, gates[:, h:2 * h] * cell + gates[:, :h] * new
            squashed = np.clip(cell, -1, 1)
            if keep:
                kept.append((state, before, cell, gates, new, squashed))
            state = gates[:, 2 * h:] * squashed
            out[t] = state
        return (out[::-1] if d else out), kept

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores [TAGS, B, T]: ``_run`` for both directions at once, laid out for speed."""
        h, (n, length), width = self.h, ids.shape, self.p["emb"].shape[1]
        scale = np.repeat(np.array([0.25, 1], np.float32), [3 * h, h])
        shift = np.repeat(np.array([0.5, 0], np.float32), [3 * h, h])
        least = np.repeat(np.array([0, -1], np.float32), [3 * h, h])[:, None]
        w = np.concatenate([self.p["wx"] * scale, (self.p["b"] * scale + shift)[:, None], self.p["wh"] * scale], 1)
        w = np.ascontiguousarray(w.transpose(0, 2, 1))  # [2, 4h, width + 1 + h]
        emb, seq = np.ascontiguousarray(self.p["emb"].T), np.ascontiguousarray(ids.T).astype(np.intp)
        given = np.zeros((2, width + 1 + h, n), np.float32)  # the symbol, a one, and the state
        given[:, width] = 1
        out, cell = np.empty((length, 2 * h, n), np.float32), np.zeros((2, h, n), np.float32)
        z, some, state = np.empty((2, 4 * h, n), np.float32), np.empty((2, h, n), np.float32), given[:, width + 1:]
        for t in range(length):
            np.take(emb, seq[t], axis=1, out=given[0, :width], mode="clip")
            np.take(emb, seq[length - 1 - t], axis=1, out=given[1, :width], mode="clip")
            np.matmul(w, given, out=z)
            np.minimum(z, 1, out=z)
            np.maximum(z, least, out=z)
            cell *= z[:, h:2 * h]
            cell += np.multiply(z[:, 3 * h:], z[:, :h], out=some)
            np.minimum(cell, 1, out=some)
            np.maximum(some, -1, out=some)
            np.multiply(some, z[:, 2 * h:3 * h], out=state)
            out[t, :h], out[length - 1 - t, h:] = state[0], state[1]
        tagged = np.matmul(np.ascontiguousarray(self.p["wo"].T), out)
        tagged += self.p["bo"][:, None]
        turned = np.empty((TAGS, n, length), np.float32)
        for i in range(0, n, 64):  # windows that stay in the cache
            turned[:, i:i + 64] = tagged[:, :, i:i + 64].transpose(1, 2, 0)
        return turned

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores [B, T, TAGS]."""
        return self.scores(ids).transpose(1, 2, 0)

    def loss(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tag sequences, and its gradient."""
        n, length = ids.shape
        runs = [self._run(ids, d, True) for d in (0, 1)]
        both = np.concatenate([r[0] for r in runs], 2)
        e, trans = both @ self.p["wo"] + self.p["bo"], self.p["trans"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, length):
            alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(length - 2, -1, -1):
            beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        rows, g = np.arange(n), gold.T
        score = sum(e[t][rows, g[t]] for t in range(length)) + sum(trans[g[t], g[t + 1]] for t in range(length - 1))
        de, dtrans = np.exp(alpha + beta - z[:, None]), np.zeros_like(trans)
        for t in range(length):
            de[t][rows, g[t]] -= 1
        for t in range(length - 1):
            pair = alpha[t][:, :, None] + trans + (e[t + 1] + beta[t + 1])[:, None, :] - z[:, None, None]
            dtrans += np.exp(pair).sum(0)
            np.subtract.at(dtrans, (g[t], g[t + 1]), 1)
        de /= n
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad |= {"trans": dtrans / n, "bo": de.sum((0, 1)), "wo": both.reshape(-1, 2 * self.h).T @ de.reshape(-1, TAGS)}
        dboth, h = de @ self.p["wo"].T, self.h
        for d in (0, 1):
            dout = dboth[:, :, d * h:(d + 1) * h]
            dout, seq = (dout[::-1], ids.T[::-1]) if d else (dout, ids.T)
            wh, dstate, dcell = self.p["wh"][d], np.zeros((n, h), de.dtype), np.zeros((n, h), de.dtype)
            every = np.empty((length, n, 4 * h), de.dtype)
            for t in range(length - 1, -1, -1):
                state, before, cell, gates, new, squashed = runs[d][1][t]
                i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
                ds = dout[t] + dstate
                dcell = dcell + ds * o * (np.abs(cell) < 1)
                dz = np.concatenate([dcell * new, dcell * before, ds * squashed, dcell * i * (np.abs(new) < 1)], 1)
                dz[:, :3 * h] *= 0.25 * ((gates > 0) & (gates < 1))
                grad["wh"][d] += state.T @ dz
                every[t] = dz
                dstate, dcell = dz @ wh.T, dcell * f
            one_hot = (seq.reshape(-1)[:, None] == np.arange(_SYMBOLS)).astype(de.dtype)
            dtable = one_hot.T @ every.reshape(-1, 4 * h)
            grad["wx"][d], grad["b"][d] = self.p["emb"].T @ dtable, dtable.sum(0)
            grad["emb"] += dtable @ self.p["wx"][d].T
        return float((z - score).mean()), grad

    def fit(self, ids: np.ndarray, gold: np.ndarray, epochs: int, rate: float = 0.03, batch: int = 32) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        r, m, step, mean = np.random.RandomState(3), {k: (0.0, 0.0) for k in self.p}, 0, 0.0
        for epoch in range(epochs):
            order, losses = r.permutation(len(ids)), []
            for i in range(0, len(ids), batch):
                some = order[i:i + batch]
                value, grad = self.loss(ids[some], gold[some])
                losses.append(value)
                step += 1
                size = np.sqrt(sum(float((x ** 2).sum()) for x in grad.values()))
                lr = rate * (1 - 0.9 * epoch / max(1, epochs - 1))
                for k, x in grad.items():
                    x = x * min(1.0, 20 / (size + 1e-9))
                    a, b = 0.9 * m[k][0] + 0.1 * x, 0.99 * m[k][1] + 0.01 * x * x
                    m[k] = (a, b)
                    self.p[k] -= (lr * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-6)).astype(
                        np.float32)
            mean = float(np.mean(losses))
        return mean

    def steps(self) -> np.ndarray:
        """Transitions of tags; only the begin or inside of a kind leads to its inside."""
        out = self.p["trans"].copy()
        for k in range(2, TAGS, 2):
            out[[i for i in range(TAGS) if i not in (k - 1, k)], k] = -1e4
        return out

    def decode(self, regions: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each region's emissions, decoded as a whole; regions of like length go together."""
        out: list = [None] * len(regions)
        trans = self.steps()
        order = sorted(range(len(regions)), key=lambda i: len(regions[i]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < min(len(order), i + 256) and len(regions[order[j]]) <= 2 * len(regions[order[i]]):
                j += 1
            some, i = order[i:j], j
            length = len(regions[some[-1]])
            e = np.zeros((length, len(some), TAGS), np.float32)
            for j, k in enumerate(some):
                e[length - len(regions[k]):, j] = regions[k]  # aligned at the end; nothing but zeros in front
            back, best = np.zeros(e.shape, np.int8), e[0]
            starts = np.array([length - len(regions[k]) for k in some])
            for t in range(1, length):
                total = best[:, :, None] + trans
                back[t] = total.argmax(1)
                best = np.where((t > starts)[:, None], total.max(1), 0) + e[t]
            at = best.argmax(1)
            path = np.empty((length, len(some)), np.int64)
            for t in range(length - 1, -1, -1):
                path[t] = at
                at = back[t][np.arange(len(some)), at]
            for j, k in enumerate(some):
                out[k] = path[starts[j]:, j]
        return out

    def open_places(self, e: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Places of tag scores [TAGS, n] that a span of the best tags can hold; all others are "outside" for certain.

        A span gains over "outside" what its places, its steps and its end gain. The bound takes
        the best of a kind's two inner steps and of all ends, so that of a place is the best beginning before it,
        the best end behind it and what lies between. Texts lie ``inside``; spans do not leave them.
        """
        t = self.steps() - self.p["trans"][0, 0]
        alone = (t[1::2, 0].max(), t[2::2, 0].max(), (t[1:, 1::2] - t[0, 1::2]).max(), 0.0)
        out, open_ = float(max(alone)), np.zeros(e.shape[1], bool)
        for k in range(1, TAGS, 2):
            own = np.where(inside, e[k + 1] - e[0] + max(t[k, k + 1], t[k + 1, k + 1]), -1e6).astype(np.float64)
            first = np.where(inside, e[k] - e[0] + t[0, k], -1e6)
            total = np.cumsum(own)
            open_ |= np.maximum.accumulate(first - total) + np.maximum.accumulate(total[::-1])[::-1] + out >= -1e-3
        return open_ & inside


def training_windows(docs: DataFrame, text: str, most: int) -> list[tuple[str, list]]:
    """At most ``most`` windows of whole-corpus texts with the spans that the patterns found in them.

    Windows around matches, around other digits and plain ones are drawn alike: those with
    the least hash, so the sample depends on the rows and on nothing else.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[list[tuple[int, str]]] = [[], []]  # plain windows, windows with digits or an @
        for batch in batches:
            got: list[set[tuple[int, str]]] = [set(x) for x in least]
            for value in batch.column("text").to_pylist():
                t = (value or b"").decode("utf-8", "replace")
                for a, _, _ in [*pii_spans(t), (len(t) // 2, 0, 0)]:
                    at = max(0, a - 24 - len(t) % 17)
                    part = t[at:at + WIDTH]
                    h = int.from_bytes(hashlib.sha256(part.encode()).digest()[:7], "big")
                    got[bool(_HINT.search(part))].add((h, part))
            least = [sorted(x)[:most // 2] for x in got]
        rows = [(i == 1, h, p) for i, x in enumerate(least) for h, p in x]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            zip(*rows) if rows else [[]] * 3, (pa.bool_(), pa.int64(), pa.string()))], ["hint", "h", "part"])

    marked = saved(mapped(docs.select(as_bytes(text).alias("text")), run, "hint boolean, h long, part string"), "windows")
    rows = [r for hint in (True, False) for r in marked.where(F.col("hint") == hint).distinct().orderBy("h", "part")
            .limit(most // 2).collect()]
    return [(r["part"], pii_spans(r["part"])) for r in rows]


def labelled_variants(windows: list[tuple[str, list]], count: int, seed: int = 5) -> list[tuple[str, list]]:
    """Plain windows with a span set into them that the patterns may miss, and with look-alikes that are none."""
    r = np.random.RandomState(seed)
    plain = [w for w, s in windows if not s] or ["the text around it goes on and on, as texts do, line after line."]
    names, hosts = ["anna", "j.smith", "maria_k", "tom-lee", "p.dubois", "info"], ["mail", "web", "post", "example"]
    ends = ["com", "org", "de", "net"]
    words = sorted({w for p in plain for w in re.findall("[a-z]{2,}", p)}) or names

    def number(n: int) -> str:
        return "".join(str(d) for d in r.randint(0, 10, n))

    def make() -> tuple[str, int]:
        k = r.randint(0, 8)
        name, host, end = names[r.randint(6)], hosts[r.randint(4)] + ["", str(r.randint(100))][r.randint(2)], ends[r.randint(4)]
        if k == 0:
            mark, dot = [(" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), ("@", ".")][r.randint(4)]
            return f"{name}{mark}{host}{dot}{end}", 0
        if k == 1:
            dots = [".", "[.]", "(.)"][r.randint(3)]
            return dots.join(str(x) for x in r.randint(1, 255, 4)), 1
        if k == 2:
            digits = number(15)
            digits += next(d for d in "0123456789" if luhn(digits + d))
            return [".", "-", " ", "_"][r.randint(4)].join(digits[i:i + 4] for i in range(0, 16, 4)), 2
        if k == 3:
            return [f"({number(3)}) {number(3)}-{number(4)}", f"00{number(2)} {number(3)} {number(7)}",
                    f"{number(3)}-{number(3)}-{number(4)}", f"+{number(2)} {number(3)} {number(6)}"][r.randint(4)], 3
        if k == 4:
            return [f"{r.randint(1, 30)}.{r.randint(10)}", f"20{number(2)}-{number(2)}-{number(2)}", number(r.randint(1, 7)),
                    f"{number(2)}:{number(2)}", f"${number(3)}.{number(2)}", f"v{r.randint(9)}.{r.randint(9)}"][r.randint(6)], -1
        if k == 5:  # prose that looks like a spelt-out address, sentences without a blank between them
            a, b, c = (words[r.randint(len(words))] for _ in range(3))
            return [f"{a} at {b}", f"{a} at {b} {c}", f"{a}.{b.capitalize()}", f"{a} dot {b}", f"at {a} at {b}", f"{a}. {b.capitalize()} at",
                    f"{a}.{b} {c}"][r.randint(7)], -1
        if k == 6:  # digits within other marks
            return ["".join("0123456789abcdef"[i] for i in r.randint(0, 16, r.randint(10, 40))), f"{number(4)}/{number(4)}/{number(3)}",
                    f"x{number(12)}y", f"{number(3)},{number(3)},{number(3)}"][r.randint(4)], -1
        return [f"@{name}", f"a@{host}", "@", number(r.randint(8, 11)), f"#{number(5)}"][r.randint(5)], -1

    out = []
    for _ in range(count):
        base = plain[r.randint(len(plain))]
        text, kind = make()
        at = r.randint(0, max(1, min(len(base), WIDTH - len(text) - 2)))
        whole = f"{base[:at]} {text} {base[at:]}"[:WIDTH]
        spans = pii_spans(whole)
        own = (at + 1, at + 1 + len(text), kind)
        if kind >= 0 and own[1] <= WIDTH and not overlaps(own, spans):
            spans = sorted([*spans, own])
        out.append((whole, spans))
    return out


#: Spelt-out and plain addresses, and digits with the separators that numbers are written with.
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(]at[\])]|\bat\b) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(](?:dot|\.)[\])]|\bdot\b) ?[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[+(]?[0-9][0-9 ().\[\]_/-]*[0-9]")


def plausible(text: str, start: int, end: int, kind: int) -> bool:
    """Whether a span of the tagger can be of its kind at all: the patterns' number rules, with any separators."""
    part = text[start:end]
    if kind == 0:
        return bool(_ADDRESS.fullmatch(part))
    if not _NUMBER.fullmatch(part) or text[max(0, start - 1):start].isalnum() or text[end:end + 1].isalnum():
        return False
    numbers = re.findall("[0-9]+", part)
    digits = "".join(numbers)
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def train(docs: DataFrame, text: str = "text", most: int = 800, variants: int = 1200, epochs: int = 7) -> Tagger:
    """Fit the tagger on at most ``most`` labelled windows and ``variants`` made from them."""
    windows = training_windows(docs, text, most)
    windows += labelled_variants(windows, variants)
    ids, gold = np.zeros((len(windows), WIDTH), np.uint8), np.zeros((len(windows), WIDTH), np.int64)
    for i, (part, spans) in enumerate(windows):
        part = part[:WIDTH]
        ids[i, :len(part)], gold[i] = symbols(part), tags(WIDTH, spans)
    tagger = Tagger()
    tagger.fit(ids, gold, epochs)
    return tagger


def tag_texts(tagger: Tagger, texts: list[str], batch: int = 1024) -> list[list]:
    """Spans that the tagger sees in each text. It is run on every window; the last ones of texts reach beyond them."""
    step = WINDOW - SHARED
    coded = [symbols(t) for t in texts]
    windows = np.array([max(1, -(-(len(s) + 1 - SHARED) // step)) if len(s) else 0 for s in coded], np.int64)
    last = np.cumsum(windows)
    first = last - windows
    flat = np.zeros(int(last[-1]) * step + len(texts) * SHARED if len(texts) else 0, np.uint8)
    base = first * step + np.arange(len(texts)) * SHARED  # windows, the last one's end, and so a place between texts
    for a, s in zip(base.tolist(), coded):
        flat[a:a + len(s)] = s
    begin = np.repeat(base - first * step, windows) + np.arange(windows.sum()) * step
    whole = np.empty((TAGS, len(flat)), np.float32)
    ramp = np.linspace(0, 1, SHARED + 2, dtype=np.float32)[1:-1]
    opens = np.zeros(int(windows.sum()), bool)
    opens[first[windows > 0]] = True
    tail = None
    for k in range(0, len(begin), batch):
        at, fresh = begin[k:k + batch], opens[k:k + batch]
        e = tagger.scores(flat[at[:, None] + np.arange(WINDOW)])
        # The first places of a window are weighed with the last ones of the window before it.
        before = np.concatenate([e[:, :1, step:] if tail is None else tail, e[:, :-1, step:]], 1)
        tail = e[:, -1:, step:].copy()
        joined = np.where(fresh[:, None], e[:, :, :SHARED], e[:, :, :SHARED] * ramp + before * (1 - ramp))
        closing = np.flatnonzero(np.append(fresh[1:], k + batch >= len(begin) or opens[min(k + batch, len(begin) - 1)]))
        end = e[:, closing, step:]
        e[:, :, :SHARED] = joined
        edge = np.flatnonzero(np.diff(at, prepend=at[0] - step) != step)  # texts' ends break the run of places
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(at)]):
            if a < b:
                whole[:, at[a]:at[a] + (b - a) * step] = e[:, a:b, :step].reshape(TAGS, -1)
        for i, j in enumerate(closing.tolist()):
            whole[:, at[j] + step:at[j] + WINDOW] = end[:, i]
    inside = np.zeros(len(flat), bool)
    for a, s in zip(base.tolist(), coded):
        inside[a:a + len(s)] = True
    open_ = tagger.open_places(whole, inside)
    wide = open_.copy()
    wide[1:] |= open_[:-1]
    wide[:-1] |= open_[1:]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], wide & inside, [False]]).astype(np.int8)))
    begins, ends = edge[::2].tolist(), edge[1::2].tolist()
    parts = []
    for a, b in zip(begins, ends):
        part = whole[:, a:b].T.copy()
        part[~open_[a:b], 1:] = -1e9
        parts.append(part)
    found: list[list] = [[] for _ in texts]
    of = (np.searchsorted(base + [len(s) for s in coded], begins, "right") if begins else [])
    for i, at, path in zip(of, begins, tagger.decode(parts)):
        if path.any():
            for a in np.flatnonzero(path % 2 == 1).tolist():
                kind, b = (int(path[a]) - 1) // 2, a + 1
                while b < len(path) and path[b] == 2 + 2 * kind:
                    b += 1
                found[i].append((at + a - int(base[i]), at + b - int(base[i]), kind))
    return found


def find_pii(docs: DataFrame, tagger: Tagger, doc_id: str = "doc_id", text: str = "text", least: int = 6) -> DataFrame:
    """``doc_id, base, spans`` for every row: arrays of (start, end, kind) in code points, by start and kind.

    ``base`` has the matches of the patterns; ``spans`` these and the tagger's own of at
    least ``least`` characters that overlap none of them and are ``plausible``. Null and empty texts have none;
    equal rows are answered each; an empty table gives an empty result; other columns are
    not read. Texts are read whole where they lie; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = [(b or b"").decode("utf-8", "replace") for b in part.column("text").to_pylist()]
                base = [pii_spans(t) for t in texts]
                more = tag_texts(shared.value, texts)
                both = [sorted([*b, *(s for s in m if s[1] - s[0] >= least and plausible(t, *s)
                                      and not overlaps(s, b))], key=lambda s: (s[0], s[2]))
                        for t, b, m in zip(texts, base, more)]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
                named = [pa.array([[{"start": a, "end": b, "kind": PII[k]} for a, b, k in s] for s in found], kind)
                         for found in (base, both)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *named, pa.array([digest(s, PII) for s in base], pa.string()),
                     pa.array([written(s, PII) for s in both], pa.string())],
                    ["doc_id", "base", "spans", "base_sha256", "written"])

    given = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("text"))
    span = "array<struct<start: int, end: int, kind: string>>"
    return mapped(given, run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, base {span}, spans {span}, "
                              "base_sha256 string, written string")
