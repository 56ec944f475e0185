"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so, so equal stretches are
cut alike wherever they stand. Each distinct chunk is moved once and gets an identifier
that was verified on its bytes; a document is then its list of identifiers, a few bytes
per kilobyte of text, and equal texts are equal lists.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import as_bytes, buffers, mapped, pieces, row_key, saved

_GEAR = np.random.RandomState(11).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray, mean_bits: int, least: int, most: int) -> list[np.ndarray]:
    """The ends of each text's chunks, relative to the text; none for an empty text.

    ``least`` must be 32 or more: the hash of a place reaches back 32 bytes.
    """
    if least < 32:
        raise ValueError("chunks must have 32 bytes at least")
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):  # the hash of 2s bytes from two of s bytes
        h[step:] += h[:-step] << np.uint32(step)
    marked = np.flatnonzero(h >> np.uint32(32 - mean_bits) == 0) + 1
    first = np.searchsorted(marked, offsets[:-1] + least)
    last = np.searchsorted(marked, offsets[1:])
    out = []
    for i, n in enumerate(np.diff(offsets)):
        ends, at = [], 0
        for x in marked[first[i]:last[i]] - offsets[i]:
            while x - at > most:
                at += most
                ends.append(at)
            if x - at >= least:
                at = int(x)
                ends.append(at)
        while n - at > most:
            at += most
            ends.append(at)
        if n > at:
            ends.append(int(n))
        out.append(np.array(ends, np.int64))
    return out


def _chunks(batch: pa.RecordBatch, cut: tuple[int, int, int], digest_bytes: int):
    """Rows, each with the digests and the bytes of its chunks."""
    for part in pieces(batch):
        data, offsets = buffers(part.column("text"))
        raw = data.tobytes()
        for i, ends in enumerate(cut_points(data, offsets, *cut)):
            at, found = int(offsets[i]), []
            start = at
            for e in ends.tolist():
                chunk = raw[start:at + e]
                found.append((xxhash.xxh3_128_digest(chunk)[:digest_bytes], chunk))
                start = at + e
            yield part, i, found


def recipes(docs: DataFrame, cut: tuple[int, int, int], digest_bytes: int) -> DataFrame:
    """``doc_id, content, sha256, recipe`` per document: ``recipe`` holds its chunks' digests end to end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [b"".join(d for d, _ in found) for _, _, found in _chunks(batch, cut, digest_bytes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), batch.column("sha256"), pa.array(got, pa.binary())],
                ["doc_id", "content", "sha256", "recipe"])

    return mapped(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, content long, sha256 string, "
                             "recipe binary")


def chunk_table(docs: DataFrame, cut: tuple[int, int, int], digest_bytes: int) -> DataFrame:
    """``digest, chunk``: the distinct chunks of each batch of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {x for _, _, found in _chunks(batch, cut, digest_bytes) for x in found}
            if seen:
                digest, chunk = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(chunk, pa.binary())],
                                                 ["digest", "chunk"])

    return mapped(docs.select("text"), run, "digest binary, chunk binary")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 cut: tuple[int, int, int] = (11, 512, 16384), digest_bytes: int = 16) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, content``.

    ``cut`` is (bits of the mean chunk length, least, most). Texts are equal when their
    bytes are; a null text equals an empty one. Of equal texts the row with the largest
    ``doc_id`` stays (a null id is smaller than any other); of rows with the same id and
    text one stays. ``content`` names a row by id and text. An empty table gives an empty result; other columns are not read.

    Identifiers are verified: distinct chunks are grouped by digest and bytes together,
    and a digest that two chunks share counts as unproven. Documents with such a chunk
    are told apart by their SHA-256 as well; at 16 bytes of digest this does not happen.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("text"),
                         row_key(doc_id, text).alias("content"))
    source = source.withColumn("sha256", F.sha2("text", 256))
    table = saved(recipes(source, cut, digest_bytes).withColumn("row", F.monotonically_increasing_id()), "recipes")
    distinct = chunk_table(source, cut, digest_bytes).distinct()
    shared = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    unproven = saved(shared, "unproven")
    keyed = table.withColumn("key", F.col("recipe"))
    if not unproven.isEmpty():
        each = table.select("row", F.explode(F.expr(
            f"transform(sequence(0, length(recipe) div {digest_bytes} - 1), "
            f"i -> substring(recipe, i * {digest_bytes} + 1, {digest_bytes}))")).alias("digest")).where("length(digest) > 0")
        doubtful = each.join(unproven, "digest").select("row").distinct()
        keyed = (table.join(doubtful.withColumn("doubt", F.lit(True)), "row", "left")
                 .withColumn("key", F.when(F.col("doubt"), F.concat(F.col("recipe"), F.unhex("sha256")))
                             .otherwise(F.col("recipe"))).drop("doubt"))
    groups = saved(keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row")).alias("best"),
    ).where("group_size > 1"), "groups")
    one = F.col("group_size").isNull()
    return keyed.join(groups, "key", "left").select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.col("sha256").alias("text_sha256"), "content")
