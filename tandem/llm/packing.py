"""Packing of token sequences with a bounded number of open windows.

Each partition of documents is packed where it lies: a piece goes to the open window it
fills best, and when it fits none the fullest window is emitted. What stays open at the
end of a partition is merged afterwards in groups of partitions.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import as_bytes, mapped, pieces, saved
from tandem.llm.tokens import encoder

_PIECE = ("doc_id {id}, row long, start long, length long, doc_tokens long, ids_crc32 long, "
          "sequence_id long, offset long, ids binary")


class Windows:
    """At most ``keep`` open windows of ``size`` tokens; pieces are (key, start, ids).

    A piece is placed whole where it leaves the least room. If no window has room for
    it, the fullest is emitted, topped up with the head of the piece if the gap is
    ``least_cut`` tokens or more, and the rest is placed as a piece of its own.
    """

    def __init__(self, size: int, keep: int, least_cut: int):
        self.size, self.keep, self.least_cut = size, keep, least_cut
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def _put(self, k: int, piece) -> list | None:
        used, held = self.open[k]
        used += len(piece[2])
        held.append(piece)
        if used == self.size:
            del self.open[k]
            return held
        self.open[k] = (used, held)
        return None

    def add(self, key, start: int, ids: np.ndarray) -> Iterator[list]:
        """Place a piece; yields the windows that are done."""
        while len(ids) >= self.size:
            yield [(key, start, ids[:self.size])]
            start, ids = start + self.size, ids[self.size:]
        while len(ids):
            fits = [(self.size - used - len(ids), k) for k, (used, _) in enumerate(self.open)
                    if used + len(ids) <= self.size]
            if fits:
                done = self._put(min(fits)[1], (key, start, ids))
                if done:
                    yield done
                return
            if len(self.open) < self.keep:
                self.open.append((len(ids), [(key, start, ids)]))
                return
            k = max(range(len(self.open)), key=lambda i: (self.open[i][0], -i))
            gap = self.size - self.open[k][0]
            if gap >= self.least_cut:
                yield self._put(k, (key, start, ids[:gap]))
                start, ids = start + gap, ids[gap:]
            else:
                yield self.open.pop(k)[1]

    def close(self) -> Iterator[list]:
        """The open windows, merged as far as they fill each other: all but the last are full."""
        rest = sorted(self.open, key=lambda w: -w[0])
        self.open = []
        self.keep = 1
        for _, held in rest:
            for piece in held:
                yield from self.add(*piece)
        if self.open:
            yield self.open.pop()[1]


def _rows(windows: Iterator[tuple[int, list]], keep_ids: Callable[[list], bool], id_type) -> pa.RecordBatch | None:
    """Pieces of numbered windows as a batch; their ids where ``keep_ids`` says so."""
    cols: list[list] = [[] for _ in range(9)]
    for number, held in windows:
        offset, keep = 0, keep_ids(held)
        for (doc_id, row, total), start, ids in held:
            raw = ids.astype("<u4").tobytes()
            for c, v in zip(cols, (doc_id, row, start, len(ids), total, zlib.crc32(raw), number, offset,
                                   raw if keep else None)):
                c.append(v)
            offset += len(ids)
    if not cols[0]:
        return None
    types = [id_type, *[pa.int64()] * 7, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      ["doc_id", "row", "start", "length", "doc_tokens", "ids_crc32", "sequence_id",
                                       "offset", "ids"])


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, separator: int = 0, keep: int = 16, least_cut: int = 1,
         merge: int = 64, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens.

    A row is ``length`` tokens of a document from ``start``, at ``offset`` of sequence
    ``sequence_id``; ``doc_tokens`` counts the whole document with the ``separator`` that
    ends it, ``ids_crc32`` is the CRC-32 of the piece's ids as little-endian 32-bit
    numbers, and ``ids`` holds these with ``with_ids``. ``row`` numbers the input rows, so
    equal ids and equal rows stay apart. Null and empty texts are the separator alone; an
    empty table gives an empty result; other columns are not read.

    A task holds ``keep`` open windows of ``size`` tokens and one document at a time. The
    one window that a partition leaves unfilled goes on to be merged with those of
    ``merge - 1`` other partitions, so one sequence in so many partitions is padded, and
    no task gets more than ``merge`` windows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("text"),
                         F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, count, part, id_type = encoder(tokenizer), Windows(size, keep, least_cut), 0, None, None
        for batch in batches:
            id_type = batch.column("doc_id").type
            for some in pieces(batch, limit=1 << 20):
                done = []
                rows, names = some.column("row").to_pylist(), some.column("doc_id").to_pylist()
                for name, row, ids in zip(names, rows, encode(some.column("text"))):
                    part = row >> 33
                    ids = np.append(ids, np.uint32(separator))
                    for held in windows.add((name, row, len(ids)), 0, ids):
                        done.append((part << 33 | count, held))
                        count += 1
                if out := _rows(iter(done), lambda _: with_ids, id_type):
                    yield out
        left = []
        for held in windows.close():
            full = sum(len(p[2]) for p in held) == size
            left.append(((part << 33 | count) if full else ~part, held))
            count += 1
        if left and (out := _rows(iter(left), lambda h: with_ids or sum(len(p[2]) for p in h) < size, id_type)):
            yield out

    schema = _PIECE.format(id=kind)
    first = saved(mapped(source, run, schema), "pieces")
    left = first.where("sequence_id < 0").withColumn("group", F.floor((-1 - F.col("sequence_id")) / merge))

    def join(key, table):
        windows, done = Windows(size, keep, least_cut), []
        table = table.sort_by([("sequence_id", "descending"), ("offset", "ascending")])
        for r in table.to_pylist():
            ids = np.frombuffer(r["ids"], "<u4")
            for held in windows.add((r["doc_id"], r["row"], r["doc_tokens"]), r["start"], ids):
                done.append(held)
        done.extend(windows.close())
        numbered = iter([(1 << 62 | key[0].as_py() << 20 | i, held) for i, held in enumerate(done)])
        out = _rows(numbered, lambda _: with_ids, table.schema.field("doc_id").type)
        return pa.Table.from_batches([out])

    merged = left.groupBy("group").applyInArrow(join, schema)
    both = first.where("sequence_id >= 0").unionByName(merged)
    return both if with_ids else both.drop("ids")
