"""Benchmark decontamination by winnowing.

Of each window of grams of words the one with the least hash is kept as a fingerprint,
so any shared span as long as a window of grams shares a fingerprint. Fingerprints of
documents and of benchmark items are joined and each hit is extended word by word.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import words as W
from tandem.llm.common import as_bytes, bitmap, buffers, in_bitmap, ints, lists, mapped, mix, pieces, row_key, saved

_HITS = "array<struct<fp: bigint, at: int, len: int, context: array<bigint>>>"


def winnow(hashes: np.ndarray, groups: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the first of equals) of every ``window`` consecutive ones of a group."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, arg = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        lower = hashes[j:j + n] < least
        least[lower], arg[lower] = hashes[j:j + n][lower], j
    whole = groups[:n] == groups[window - 1:]
    chosen = np.zeros(len(hashes), bool)
    chosen[np.flatnonzero(whole) + arg[whole]] = True
    return np.flatnonzero(chosen)


def _contexts(w: W.Words, at: np.ndarray, length: int, around: int) -> np.ndarray:
    """Hashes of the words of each gram and of ``around`` words on both sides; 0 beyond the text."""
    index = at[:, None] + np.arange(-around, length + around)
    inside = (index >= 0) & (index < len(w.hash))
    index = np.clip(index, 0, max(0, len(w.hash) - 1))
    same = inside & (w.doc[index] == w.doc[at][:, None])
    return np.where(same, w.hash[index], np.uint64(0))


def _fingerprints(w: W.Words, span: int, gram: int, short: list[int], items: bool, known: np.ndarray | None):
    """(hash, first word, words, contexts) of each level: long spans first, then whole short items.

    The fingerprint of an item of fewer than ``span`` words is the item itself; in
    documents every run of so many words is one (a window of one gram).
    """
    levels = [(gram, span - gram + 1, span - gram)] + [(n, 1, 0) for n in short]
    for length, window, around in levels:
        hashes, at = W.grams(w, length)
        if items and not around:
            whole = w.counts[w.doc[at]] == length
            hashes, at = hashes[whole], at[whole]
        hashes = mix(hashes ^ np.uint64(length))
        kept = winnow(hashes, w.doc[at], window)
        hashes, at = hashes[kept], at[kept]
        if known is not None:
            kept = in_bitmap(known, hashes)
            hashes, at = hashes[kept], at[kept]
        yield hashes.view(np.int64), at, length, _contexts(w, at, length, around)


def _scan(df: DataFrame, span: int, gram: int, short: list[int], items: bool, known=None) -> DataFrame:
    """``id, content, n_words, hits`` per row of ``df`` (id, content, text)."""
    shared = None if known is None else df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        for batch in batches:
            for part in pieces(batch):
                w = W.words(*buffers(part.column("text")), W.ALNUM)
                got = list(_fingerprints(w, span, gram, short, items, bits))
                doc = np.concatenate([w.doc[at] for _, at, _, _ in got])
                order = np.argsort(doc, kind="stable")
                context = pa.concat_arrays([lists(pa.array(c.view(np.int64).ravel()), np.full(len(c), c.shape[1]))
                                            for *_, c in got])
                first = np.concatenate([at - w.first[w.doc[at]] for _, at, _, _ in got])
                rows = pa.StructArray.from_arrays(
                    [ints(np.concatenate([h for h, *_ in got])), pa.array(first.astype(np.int32)),
                     pa.array(np.concatenate([np.full(len(a), n, np.int32) for _, a, n, _ in got])), context],
                    ["fp", "at", "len", "context"]).take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("content"), ints(w.counts),
                     lists(rows, np.bincount(doc, minlength=len(w.counts)))], ["id", "content", "n_words", "hits"])

    return mapped(df, run, f"id {df.schema['id'].dataType.simpleString()}, content bigint, "
                           f"n_words bigint, hits {_HITS}")


def _run_lengths(around: int, gram: int) -> tuple[str, str]:
    """SQL for the words that agree to the left and to the right of a gram of both contexts."""
    def chain(places: list[int]) -> str:
        tests = " ".join(f"when context[{p}] = 0 or context[{p}] <> theirs[{p}] then {i}"
                         for i, p in enumerate(places))
        return f"case when size(context) < {2 * around + gram} then 0 {tests} else {len(places)} end"

    return chain(list(range(around - 1, -1, -1))), chain(list(range(around + gram, 2 * around + gram)))


def benchmark_hits(docs: DataFrame, items: DataFrame, span: int = 10, gram: int = 5,
                   doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items, content``.

    Words are runs of letters and digits, A-Z lower-cased. A document hits an item where
    ``span`` consecutive words of it agree with the item's; an item of fewer words must
    agree as a whole. ``spans`` are the disjoint [start, end) word ranges that lie in any
    hit, in order; ``items`` the ids of the items, as strings, sorted; both empty without
    hits. Null and empty texts have no words and hit nothing; an item with a null id adds
    spans but no id; equal rows are answered each; ``content`` names a row by id and text; empty tables give no hits or an empty
    result. Other columns are not read.

    The fingerprints of the items filter those of the documents through a bitmap of fixed
    size before the join, so a document's words are read once and only likely hits are
    shuffled. A fingerprint that many documents hold is a hot key of a plain sort-merge
    join, which adaptive execution splits; equal contexts of items are one row of it.
    """
    rows = items.select(F.col(item_id).cast("string").alias("id"), row_key(item_id, text).alias("content"),
                        as_bytes(text).alias("text"))
    lengths = list(range(1, span))
    found = saved(_scan(rows, span, gram, lengths, True).select("id", F.explode("hits").alias("h"))
                  .groupBy("h.fp", "h.len", "h.context")
                  .agg(F.array_sort(F.collect_set("id")).alias("ids")), "items")
    present = sorted(r[0] for r in found.where(F.size("context") == F.col("len")).select("len").distinct().collect())
    source = docs.select(F.col(doc_id).alias("id"), row_key(doc_id, text).alias("content"), as_bytes(text).alias("text"))
    scanned = saved(_scan(source, span, gram, present, False, bitmap(found, "fp"))
                    .withColumn("row", F.monotonically_increasing_id()), "documents")
    theirs = found.select("fp", "len", F.col("context").alias("theirs"), "ids")
    left, right = _run_lengths(span - gram, gram)
    at = span - gram
    body = (f"case when size(context) = len then context = theirs "
            f"else slice(context, {at + 1}, {gram}) = slice(theirs, {at + 1}, {gram}) end")
    hits = (scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
            .join(theirs, ["fp", "len"]).where(F.expr(body))
            .withColumns({"l": F.expr(left), "r": F.expr(right)})
            .where(F.expr(f"size(context) = len or l + len + r >= {span}"))
            .select("row", F.expr("struct(at - l as start, at + len + r as end)").alias("s"), "ids"))
    merged = hits.groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("s"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    step = ("aggregate(s, cast(array() as array<struct<start: int, end: int>>), (done, x) -> "
            "case when size(done) > 0 and element_at(done, -1).end >= x.start "
            "then concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start, "
            "greatest(element_at(done, -1).end, x.end) as end))) else concat(done, array(x)) end)")
    merged = saved(merged.select("row", F.expr(step).alias("spans"), "items"), "hits")
    return scanned.select(F.col("id").alias("doc_id"), "n_words", "row", "content").join(merged, "row", "left").select(
        "doc_id", "n_words",
        F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, end: int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), "content")
