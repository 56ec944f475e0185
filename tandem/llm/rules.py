"""Quality rules under weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

No rule rejects a document by itself. Each votes good, bad or not at all; how far a vote for
either class can be trusted is estimated from the agreement of the rules over all documents, and a
document is kept by its posterior probability. Documents with the same votes are alike to the
model, so the estimation needs only how often each combination of votes occurs: at
most 3 to the number of rules rows, however many documents there are.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import as_bytes, buffers, ints, mapped, pieces, saved

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL, _DIGIT, _UPPER, _STOP, _BULLET = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT[48:58] = True
_UPPER[65:91] = True
_STOP[list(b".!?")] = True
_BULLET[list(b"-*+")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_PLAIN = _LETTER | _DIGIT
_FIRST = np.ones(256, bool)  # bytes that begin a code point
_FIRST[0x80:0xC0] = False

#: What is counted in a text.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper",
         "n_letter_words", "n_distinct", "n_stops", "n_bullets", "n_letters", "n_plain_words")


@dataclass(frozen=True)
class Rule:
    """SQL conditions over ``STATS``; a rule votes bad, else good, else abstains."""
    name: str
    bad: str
    good: str


#: Limits after published rule sets for web text (fixed values): lengths, symbols, repeats, letters, bullets.
RULES = (
    Rule("length", "n_words < 50 or n_words > 100000", "n_words between 80 and 20000"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words",
         "word_chars between 3.5 * n_words and 9 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words and n_words > 0"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines > 1"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words and n_words > 0"),
    Rule("letters", "10 * n_letter_words < 8 * n_words or n_words = 0", "100 * n_letter_words >= 97 * n_words and n_words > 0"),
    Rule("letter_share", "100 * n_letters < 75 * word_chars", "100 * n_letters >= 88 * word_chars and n_words > 0"),
    Rule("marks", "10 * (word_chars - n_letters - n_digits) > 2 * word_chars",
         "100 * (word_chars - n_letters - n_digits) <= 8 * word_chars and n_words > 0"),
    Rule("plain_words", "10 * n_plain_words < 5 * n_words", "10 * n_plain_words >= 7 * n_words and n_words > 0"),
    Rule("digits", "10 * n_digits > 2 * word_chars", "100 * n_digits <= 3 * word_chars and n_words > 0"),
    Rule("capitals", "10 * n_upper > 3 * word_chars", "100 * n_upper between 0.5 * word_chars and 8 * word_chars"),
    Rule("sentences", "n_words >= 50 and 100 * n_stops < n_words", "100 * n_stops between 3 * n_words and 30 * n_words"),
    Rule("bullets", "10 * n_bullets > 9 * n_lines", "10 * n_bullets <= n_lines and n_lines > 0"),
    Rule("variety", "n_words >= 50 and n_words < 1000 and 10 * n_distinct < 2 * n_words",
         "n_words between 50 and 2000 and 10 * n_distinct >= 4 * n_words"),
)


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the runs of marked bytes in texts that lie end to end."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return start, stop, np.searchsorted(offsets, start, "right") - 1


def _codes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A number for each span, the same for equal bytes only."""
    size = stop - start
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds),
                                                                            pa.py_buffer(data[at].tobytes())])
    return held.dictionary_encode().indices.to_numpy().astype(np.int64)


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``STATS`` of texts that lie end to end at ``offsets``; equality is by bytes."""
    n, space = len(offsets) - 1, _SPACE[data]
    start, stop, doc = _spans(~space, offsets)
    code = _codes(data, start, stop)
    words = np.bincount(doc, minlength=n)
    width = int(code.max(initial=0)) + 1
    distinct = np.bincount(np.unique(doc * width + code) // width, minlength=n)
    # Runs of three words of one text are numbered pair by pair, so equal numbers are equal words.
    at = np.flatnonzero(doc[:max(0, len(doc) - 2)] == doc[2:]) if len(doc) > 2 else np.empty(0, np.int64)
    key = doc[at]
    for j in range(3):
        _, key, count = np.unique(key * width + code[at + j], return_inverse=True, return_counts=True)
    again = np.zeros(len(doc), bool)
    if len(at):
        twice = at[count[key] > 1]
        for j in range(3):
            again[twice + j] = True
    left, right, line_doc = _spans(data != 0x0A, offsets)
    letters = np.concatenate([[0], np.cumsum(~space)])
    full = letters[right] > letters[left]
    left, right, line_doc = left[full], right[full], line_doc[full]
    line = _codes(data, left, right)
    key = line_doc * (int(line.max(initial=0)) + 1) + line
    once = np.unique(key, return_index=True)[1]
    first = left + _leading(space, left, right)
    more = {
        "n_words": words, "word_chars": _sums(_FIRST[data] & ~space, offsets), "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_doc, minlength=n) - np.bincount(line_doc[once], minlength=n),
        "n_repeat_words": np.bincount(doc[again], minlength=n), "n_lines": np.bincount(line_doc, minlength=n),
        "n_digits": _sums(_DIGIT[data], offsets), "n_upper": _sums(_UPPER[data], offsets),
        "n_letter_words": np.bincount(doc[_any(_LETTER[data], start, stop)], minlength=n), "n_distinct": distinct,
        "n_stops": np.bincount(doc[_STOP[data[stop - 1]]] if len(stop) else doc, minlength=n),
        "n_bullets": np.bincount(line_doc[_BULLET[data[first]]] if len(first) else line_doc, minlength=n),
        "n_letters": _sums((_LETTER & _FIRST)[data], offsets),
        "n_plain_words": words - np.bincount(doc[_any(~_PLAIN[data], start, stop)], minlength=n)}
    return {k: more[k] for k in STATS}


def _any(marks: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[stop] > total[start]


def _leading(space: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many blanks stand in front of the first word of each line that has one."""
    solid = np.flatnonzero(~space)
    return solid[np.searchsorted(solid, left)] - left if len(left) else left


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``STATS`` for every row; a null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                stats = text_stats(*buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(ints(x) for x in stats.values())],
                                                 ["doc_id", *STATS])

    given = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("text"))
    return mapped(given, run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, "
                  + ", ".join(f"{s} long" for s in STATS))


def vote(rule: Rule) -> Column:
    return F.expr(f"case when {rule.bad} then -1 when {rule.good} then 1 else 0 end")


@dataclass
class Votes:
    """What is learned: the share of good documents and, for each rule, how often its votes are right in either class."""
    share: float
    good: np.ndarray
    bad: np.ndarray

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-odds of good without votes, and what each rule's vote for good or bad adds; an abstention says nothing."""
        return (float(np.log(self.share) - np.log1p(-self.share)), np.log(self.good) - np.log1p(-self.bad),
                np.log1p(-self.good) - np.log(self.bad))

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log-odds of good for each row of votes (-1, 0, 1)."""
        start, up, down = self.weights()
        return start + (votes == 1) @ up + (votes == -1) @ down

    def probability(self, name: str) -> Column:
        """The posterior of the combination of votes in column ``name``."""
        start, up, down = self.weights()
        odds = F.lit(start)
        for i, (u, d) in enumerate(zip(up.tolist(), down.tolist())):
            digit = F.floor(F.col(name) / 3 ** i) % 3
            odds = odds + F.when(digit == 2, u).when(digit == 0, d).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 500, prior: float = 0.02,
        expected: tuple[float, float] = (0.98, 0.2)) -> Votes:
    """Expectation-maximisation over combinations of votes (rows of -1, 0, 1) and how often each occurs.

    ``expected`` are the shares of right votes that a rule begins with: on good documents nearly
    all, on bad ones few, as most kinds of bad documents are not what a rule looks for. Estimates
    are drawn towards them by as many votes as ``prior`` times the rule has, so they do not
    depend on the table's size. No vote may come to speak for the other class.
    """
    n = votes.shape[1]
    model = Votes(0.5, np.full(n, expected[0]), np.full(n, expected[1]))
    counts = counts.astype(float)
    if not counts.sum():
        return model
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-model.odds(votes)))
        weight = prior * ((votes != 0).T @ counts) + 1e-9
        right = []
        for share, value, usual in ((p, 1, expected[0]), (1 - p, -1, expected[1])):
            held = counts * share
            yes, all_ = (votes == value).T @ held, (votes != 0).T @ held
            right.append(np.clip((yes + weight * usual) / (all_ + weight), 1e-4, 1 - 1e-4))
        new = Votes(float(np.clip((counts @ p) / counts.sum(), 0.01, 0.99)), right[0], np.maximum(right[1], 1 - right[0]))
        step = max(abs(new.share - model.share), np.abs(new.good - model.good).max(), np.abs(new.bad - model.bad).max())
        model = new
        if step < 1e-9:
            break
    return model


def combinations(stats: DataFrame, rules: Sequence[Rule], name: str) -> DataFrame:
    """``stats`` with the number of each row's combination of votes: digits of base 3, the first rule's last."""
    total = F.lit(0)
    for i, rule in enumerate(rules):
        total = total + (vote(rule) + 1) * 3 ** i
    return stats.withColumn(name, total.cast("long"))


def unpacked(codes: np.ndarray, rules: int) -> np.ndarray:
    return np.stack([codes // 3 ** i % 3 for i in range(rules)], 1).astype(np.int64) - 1


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, least: float = 0.5, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """``doc_id``, ``STATS``, ``votes``, ``p_good`` and ``good`` (``p_good >= least``) for every row of ``docs``.

    ``votes`` is the number of the combination. The model is fitted on the combinations of all rows.
    Null and empty texts have no words and are judged by the rules that say so; repeated rows count
    each; equal texts get equal verdicts; an empty table gives an empty result; other columns are not
    read. At most 15 rules, so that there are no more than 3**15 combinations.
    """
    if not 0 < len(rules) <= 15:
        raise ValueError("between 1 and 15 rules")
    stats = saved(combinations(counted(docs, doc_id, text), rules, "votes"), "votes")
    seen = stats.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").toArrow()
    codes, counts = (seen.column(c).to_numpy().astype(np.int64) for c in ("votes", "n"))
    rows = stats.withColumn("p_good", fit(unpacked(codes, len(rules)), counts).probability("votes"))
    return rows.withColumn("good", F.col("p_good") >= least)
