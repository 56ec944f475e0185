"""Language identification by rank-order profiles of n-grams.

A language's profile is its most frequent n-grams of one to three letters in order. A
document goes to the profile from which its own ranking differs least, summed over its
n-grams by how far each is out of place.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import as_bytes, mapped, pieces

_BITS = 18
_EDGE = 1  # the symbol for whatever is not a letter
_TEXTS = 1 << (63 - 3 * _BITS)
_CHUNK = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """The number of each code point's lower-case letter, from 2; 1 for what is not a letter."""
    out, number = np.full(0x110000, _EDGE, np.int64), {}
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = number.setdefault(low if len(low) == 1 else chr(c), len(number) + 2)
    return out


def gram_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of at most 512 texts of a binary column, in order of text and n-gram.

    N-grams are runs of one to three letters of a word; those of two and three letters may
    start or end with the word's edge.
    """
    texts = ["\0" + (b or b"").decode("utf-8", "replace") for b in column.to_pylist()]
    chars = np.frombuffer(("".join(texts) + "\0").encode("utf-32-le"), np.uint32)
    s = _letters()[chars]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != _EDGE) | (s[:-1] != _EDGE)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    doc = np.append(doc, len(texts) - 1)[keep] << 3 * _BITS
    s = s[keep]
    letter = s != _EDGE
    mid = np.flatnonzero(letter)
    one = doc[mid] | s[mid]
    two = np.where(letter[:-1], doc[:-1], doc[1:]) | s[:-1] << _BITS | s[1:]
    three = doc[mid] | s[mid - 1] << 2 * _BITS | s[mid] << _BITS | s[mid + 1]
    keys = np.sort(np.concatenate([one, two, three])) if len(mid) else np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return keys >> 3 * _BITS, keys & ((1 << 3 * _BITS) - 1), counts


def learn_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = 300) -> DataFrame:
    """``lang, gram, rank``: the ``top`` most frequent n-grams of each language over all rows of ``docs``.

    Rows without a language are not used; equal counts are ordered by n-gram. Tasks add up
    their counts before the shuffle, and each language's best are found in slices first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)

        def flush() -> pa.RecordBatch:
            known = list(names)
            return pa.RecordBatch.from_arrays(
                [pa.array([known[i] for i in (keys >> 3 * _BITS).tolist()], pa.string()),
                 pa.array(keys & ((1 << 3 * _BITS) - 1)), pa.array(sums)], ["lang", "gram", "n"])

        for batch in batches:
            for part in pieces(batch, limit=_CHUNK, rows=_TEXTS):
                langs = part.column("lang").to_pylist()
                if len(set(langs) | set(names)) > _TEXTS or len(keys) > 1 << 20:
                    yield flush()
                    names, keys, sums = {}, np.empty(0, np.int64), np.empty(0, np.int64)
                local = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
                text_no, gram, n = gram_counts(part.column("text"))
                both = np.concatenate([keys, local[text_no] << 3 * _BITS | gram])
                order = np.argsort(both, kind="stable")
                both, amount = both[order], np.concatenate([sums, n])[order]
                first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else []
                keys = both[first]
                sums = np.add.reduceat(amount, first) if len(keys) else amount
        if len(keys):
            yield flush()

    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"),
                                                          as_bytes(text).alias("text"))
    counts = mapped(labelled, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = [F.desc("n"), F.asc("gram")]
    some = counts.withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(64)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*best)))
    return (some.where(F.col("r") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)) - 1)
            .where(F.col("rank") < top).select("lang", "gram", "rank"))


def identify(docs: DataFrame, profiles: DataFrame, top: int = 300, doc_id: str = "doc_id",
             text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns ``carry`` for every row of ``docs``.

    ``score`` is 1 minus the distance to the chosen profile over the largest possible one.
    Of equally near languages the first by name is taken. ``und`` with score 0 where a text
    is null, has no letters, or no language was learned. Whole texts are read; nothing is
    shuffled. The profiles, ``top`` rows for each language, go to every task.
    """
    rows = sorted((r["lang"], r["gram"], r["rank"]) for r in profiles.collect())
    langs = sorted({r[0] for r in rows})
    grams = np.unique(np.array([r[1] for r in rows], np.int64))
    ranks = np.full((len(grams) + 1, len(langs)), -1, np.int32)
    for name, gram, rank in rows:
        ranks[np.searchsorted(grams, gram), langs.index(name)] = rank
    shared = docs.sparkSession.sparkContext.broadcast((langs, grams, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, grams, ranks = shared.value
        for batch in batches:
            for part in pieces(batch, limit=_CHUNK, rows=_TEXTS):
                doc, gram, n = gram_counts(part.column("text"))
                order = np.argsort(doc << 32 | ((1 << 32) - 1 - n), kind="stable")
                doc, gram = doc[order], gram[order]
                first = np.searchsorted(doc, np.arange(part.num_rows))
                rank = np.arange(len(doc)) - first[doc]
                doc, gram, rank = doc[rank < top], gram[rank < top], rank[rank < top]
                pred, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                if len(doc) and len(langs):
                    at = np.searchsorted(grams, gram)
                    at[grams[np.minimum(at, len(grams) - 1)] != gram] = len(grams)
                    theirs = ranks[at]
                    off = np.where(theirs < 0, top, np.abs(theirs - rank[:, None]))
                    have, start, size = np.unique(doc, return_index=True, return_counts=True)
                    total = np.add.reduceat(off, start, axis=0)
                    pred[have] = total.argmin(1)
                    score[have] = 1 - total.min(1) / (top * size)
                names = pa.array([langs[p] if p >= 0 else "und" for p in pred.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], names, pa.array(score)],
                                                 [*part.schema.names[:-1], "lang_pred", "score"])

    given = docs.select(F.col(doc_id).alias("doc_id"), *carry, as_bytes(text).alias("__text"))
    given = given.withColumnRenamed("__text", "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return mapped(given, run, f"{schema}, lang_pred string, score double")
