"""Shards along a Hilbert curve through several metadata dimensions.

Neighbours on the curve are neighbours in every dimension, so each shard covers a small
box of the metadata space and a reader that filters on any of the dimensions can skip
most shards by their minimum and maximum.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tandem.llm.common import mapped, saved


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of integer points ``coords`` (n x dimensions), each below ``2**bits``.

    The axes are untangled from the highest bit down: where an axis has the bit set, the
    lower bits of the first axis are reflected, else exchanged with the axis; a Gray code
    over the axes gives the transposed index, whose bits are then interleaved.
    """
    x = coords.T.astype(np.uint64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for axis in x:
            on = (axis & high) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ axis) & low)  # 0 for the first axis itself
            x[0] ^= np.where(on, low, swap)
            axis ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & np.uint64(1 << b), np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << np.uint64(1)) | ((x[d] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` sorted by range, saved, with ``part`` and ``at``, the place within the part."""
    ranged = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("number", F.monotonically_increasing_id()), "ranged")
    return ranged.select("*", F.shiftright("number", 33).alias("part"),
                         F.col("number").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).drop("number")


def _starts(parts: DataFrame) -> DataFrame:
    """``part, before, whole``: from ``part, n`` the sum of the parts before each, and of all. A row for each partition."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                        F.sum("n").over(Window.partitionBy()).alias("whole"))


def string_bounds(values: DataFrame, cells: int) -> list[str]:
    """At most ``cells - 1`` of the whole strings ``values.value`` that cut the rows into runs of about equal length.

    Counts of distinct strings are sorted by range and cumulated part by part; the driver gets the bounds.
    """
    counts = saved(values.where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n")), "counts")
    rows = _numbered(counts, ["value"])
    starts = _starts(rows.groupBy("part").agg(F.sum("n").alias("n")))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), "part")
    cell = F.floor((F.col("before") + F.col("own")) / F.col("whole") * cells)
    got = placed.groupBy(cell.alias("cell")).agg(F.min("value").alias("value")).collect()  # one row a cell
    return sorted((r["value"] for r in got), key=lambda v: v.encode())[1:]


def hilbert_shards(docs: DataFrame, shards: int, dimensions: Sequence[str], tie: Sequence[str] = (),
                   bits: int = 5) -> DataFrame:
    """``docs`` with ``curve``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Every dimension is quantised at its ``2**bits - 1`` quantiles (numbers: approximate; strings: whole ones, by
    exact counts; only these boundaries reach the driver), null being the lowest. Rows are sorted
    by curve index, then by ``tie``, and cut into runs whose lengths differ by one at
    most. The sort is by range with a unique last key, so equal rows, a hot dimension
    value or a single cell are spread over many tasks. With fewer rows than shards some
    shards stay empty; an empty table gives an empty result; columns of ``docs`` with the names of the
    three new ones are replaced. ``docs`` is read once per pass, so hand over the slim columns only.
    """
    names, cells = [f"d{i}" for i in range(len(dimensions))], 1 << bits
    strings = [isinstance(docs.schema[d].dataType, StringType) for d in dimensions]
    columns = [F.col(d) if text else F.col(d).cast("double") for d, text in zip(dimensions, strings)]
    slim = saved(docs.select(F.struct(*docs.columns).alias("given"), *(c.alias(n) for c, n in zip(columns, names)),
                             F.monotonically_increasing_id().alias("row")), "points")
    marks = [k / cells for k in range(1, cells)]
    numbers = [n for n, text in zip(names, strings) if not text]
    edges = slim.agg(F.count(F.lit(1)), *(F.percentile_approx(n, marks, 10000).alias(n) for n in numbers)).head()
    bounds = [string_bounds(slim.select(F.col(n).alias("value")), cells) if text else sorted(set(edges[n] or []))
              for n, text in zip(names, strings)]

    def cell(name: str, marks: list) -> Column:
        """How many bounds a value has reached; one more where a cell is left for null."""
        total = F.lit(int(len(marks) + 1 < cells))
        for mark in marks:
            total = total + (F.col(name) >= F.lit(mark)).cast("int")
        # not a number is taken for null
        return F.coalesce(F.when(~F.isnan(F.col(name)) if name in numbers else F.lit(True), total), F.lit(0)).alias(name)

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            yield pa.RecordBatch.from_arrays([batch.column("given"), batch.column("row"), pa.array(hilbert_index(got, bits))],
                                             ["given", "row", "curve"])

    celled = slim.select("given", "row", *(cell(n, b) for n, b in zip(names, bounds)))
    placed = mapped(celled, curve, f"given {slim.schema['given'].dataType.simpleString()}, row long, curve long")
    keyed = placed.select("*", *(F.col("given")[t].alias(f"tie{i}") for i, t in enumerate(tie)))
    rows = _numbered(keyed, ["curve", *(f"tie{i}" for i in range(len(tie))), "row"])
    starts = _starts(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    out = (rows.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("at"))
           .withColumn("shard", F.expr(f"cast(rank * {shards} div whole as int)"))
           .withColumn("slot", F.expr(f"rank - (shard * whole + {shards - 1}) div {shards}")))
    kept = [c for c in docs.columns if c.lower() not in ("curve", "shard", "slot")]
    return out.select(*(F.col("given")[c].alias(c) for c in kept), "curve", "shard", "slot")
