"""Removal of repeated byte strings, by sorting content-sampled suffixes.

A difference cover samples suffixes so that any two equal strings have a sample at the
same distance from their starts. Here the cover is content-defined: of each ``length``
bytes the first of the least hashes of ``gram`` bytes is a sample. Samples are ordered and
named by their bytes and surroundings; the remaining suffixes follow from the sample they
hold and their distance to it; neighbours with equal prefixes are repeats.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import as_bytes, bitmap, bitmap_filter, buffers, ints, mapped, pieces, row_key, saved, sieve

_GEAR = np.random.RandomState(17).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_STEP = 1 << 19


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of the ``gram`` bytes from each position; ``gram`` is a power of two."""
    h, size = _GEAR[data], 1
    while size < gram:
        h = h[:-size] * np.uint32(0x9E3779B1) ** np.uint32(size) + h[size:]
        h ^= h >> np.uint32(15)
        size *= 2
    return h * np.uint32(0x85EBCA77)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, from minima towards both ends of blocks."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def samples(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, place, first start, last start) of each sample of the texts that lie at ``offsets``.

    The strings of ``length`` bytes that start from the first to the last start, and no
    others, have this sample as their own. All are positions in ``data``.
    """
    starts, places = [], []
    for s in range(0, len(data) - length + 1, _STEP):
        h = rolling(data[s:s + _STEP + length - 1], gram)
        least = sliding_min(h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64),
                            length - gram + 1)
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + s
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        starts.append(new + s)
        places.append(place[new])
    if not starts:
        return (np.empty(0, np.int64),) * 4
    start, place = np.concatenate(starts), np.concatenate(places)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    start, place = start[new], place[new]
    last = np.append(start[1:], len(data) - length + 1) - 1
    doc = np.searchsorted(offsets, place, "right") - 1
    first, last = np.maximum(start, offsets[doc]), np.minimum(last, offsets[doc + 1] - length)
    kept = first <= last
    return doc[kept], place[kept], first[kept], last[kept]


def _sample_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``name, context, row, place, first, last`` of every sample, positions within the text.

    ``name`` is a hash of the sample's own bytes, ``context`` of all bytes that a string
    with this sample may hold, and of where the sample lies in them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                data, offsets = buffers(part.column("text"))
                doc, place, first, last = samples(data, offsets, length, gram)
                raw, xx = memoryview(data.tobytes()), xxhash.xxh3_64_intdigest
                names = np.fromiter((xx(raw[p:p + gram]) for p in place.tolist()), np.uint64, len(place))
                contexts = np.fromiter((xx(raw[a:b + length], p - a) for a, b, p in zip(
                    first.tolist(), last.tolist(), place.tolist())), np.uint64, len(place))
                rows, base = part.column("row").to_numpy(), offsets[doc]
                yield pa.RecordBatch.from_arrays(
                    [ints(names.view(np.int64)), ints(contexts.view(np.int64)), ints(rows[doc]), ints(place - base),
                     ints(first - base), ints(last - base)], ["name", "context", "row", "place", "first", "last"])

    return mapped(docs.select("row", "text"), run,
                  "name long, context long, row long, place long, first long, last long")


def _block_rows(docs: DataFrame, length: int, step: int) -> DataFrame:
    """The strings of each listed sample, ``step`` starts together, in the columns of samples.

    Starts are grouped by their distance to the sample, so equal strings fall into the
    same block. ``name`` covers the bytes that all strings of the block hold, ``context``
    those that any holds; a block that is cut short by its sample's range has a context of
    its own. With a ``step`` of 1 both are the string itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in pieces(batch, limit=1 << 19):
                out: list[tuple[int, ...]] = []
                for text, row, edges in zip(*(part.column(c).to_pylist() for c in ("text", "row", "edges"))):
                    raw = memoryview(text)
                    for e in edges:
                        seed, p, near, far = e["name"] & 0x7FFFFFFFFFFFFFFF, e["place"], e["place"] - e["last"], \
                            e["place"] - e["first"]
                        for d in range(near // step * step, far + 1, step):
                            name = xx(raw[p - d:p + length - d - step + 1], seed ^ d)
                            low, high = max(d, near), min(d + step - 1, far)
                            if high - low + 1 == step:
                                context = xx(raw[p - d - step + 1:p + length - d], seed ^ d)
                            else:
                                context = xx(b"%d %d %d" % (row, p, d), seed)
                            out.append((name, context, row, p, p - high, p - low))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [*(ints(np.array(c, np.uint64).view(np.int64)) for c in cols[:2]),
                         *(pa.array(c, pa.int64()) for c in cols[2:])],
                        ["name", "context", "row", "place", "first", "last"])

    return mapped(docs.select("row", "text", "edges"), run,
                  "name long, context long, row long, place long, first long, last long")


def _settle(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of named stretches: (those that repeat with their whole context, those that a finer look must decide).

    The latter are one for each distinct context of a name with several.
    """
    again = saved(every.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "names")
    members = saved(every.join(again, "name"), "members")
    contexts = saved(members.groupBy("name", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place", "first", "last")).alias("one")), "contexts")
    several = saved(contexts.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("name"), "several")
    whole = (members.join(contexts.where("n > 1").select("name", "context"), ["name", "context"])
             .select("row", "first", "last"))
    return whole, contexts.join(several, "name").select("name", "one.*")


def _cut(docs: DataFrame, length: int, skip: np.ndarray | None = None) -> DataFrame:
    """Texts without the bytes of ``repeats`` (first and last starts of repeated strings).

    Rows that may be in the bitmap ``skip`` are left out.
    """
    shared = None if skip is None else docs.sparkSession.sparkContext.broadcast(skip)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch if shared is None else sieve(batch, "row", shared.value, keep=False)):
                spans, kept, digests = [], [], []
                for text, repeats in zip(part.column("text").to_pylist(), part.column("repeats").to_pylist()):
                    runs: list[list[int]] = []
                    for a, b in sorted((r["first"], r["last"] + length) for r in repeats or []):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else text
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    kept.append(rest)
                    digests.append(hashlib.sha256(rest).hexdigest())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                sizes = np.diff(buffers(part.column("text"))[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), ints(sizes), pa.array(spans, kind), pa.array(kept, pa.binary()),
                     pa.array(digests, pa.string())], ["doc_id", "n_bytes", "removed", "kept", "kept_sha256"])

    return mapped(docs.select("doc_id", "row", "text", "repeats"), run,
                  f"doc_id {id_type}, n_bytes long, removed array<struct<start: bigint, end: bigint>>, kept binary, "
                  "kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 32, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, removed, kept, kept_sha256``: each text without its repeated bytes.

    A byte is removed if it lies in a string of ``length`` bytes that starts anywhere else
    too, in the same document or another, overlaps included; strings do not cross
    documents and are judged on the input. ``removed`` are the maximal runs [start, end),
    ``kept`` the remaining bytes. Null and empty texts, and those shorter than ``length``,
    lose nothing; equal rows repeat each other; an empty table gives an empty result;
    other columns are not read.

    A sample whose context occurs twice repeats with all its strings. Only where one name
    has several contexts, at the ends of repeats, its strings are named anew in blocks and
    then one by one, for each distinct context once. All grouping is by combinable aggregates and plain
    joins of saved tables, so a passage in a third of the rows is split over many tasks.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("text"), row_key(doc_id, text).alias("row"))
    whole, edges = _settle(saved(_sample_rows(source, length, gram), "samples"))
    found = [whole]
    for step in (min(32, gram), 1):
        by_row = saved(edges.groupBy("row").agg(F.collect_list(F.struct("name", "place", "first", "last"))
                                                .alias("edges")), "edges")
        near = bitmap_filter(source.select("row", "text"), "row", bitmap(by_row, "row")).join(by_row, "row")
        whole, edges = _settle(saved(_block_rows(near, length, step), "blocks"))
        found.append(whole)
    repeats = saved(reduce(DataFrame.unionByName, found).groupBy("row").agg(
        F.collect_set(F.struct("first", "last")).alias("repeats")), "repeats")
    touched = bitmap(repeats, "row")
    changed = bitmap_filter(source, "row", touched).join(repeats, "row", "left")
    same = source.withColumn("repeats", F.lit(None).cast("array<struct<first: bigint, last: bigint>>"))
    return _cut(changed, length).unionByName(_cut(same, length, touched))
