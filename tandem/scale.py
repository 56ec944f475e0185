"""Helpers that keep ordered and keyed work spread out when keys are hot."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[str],
    fine: Sequence[str | Column],
    name: str = "pos",
) -> DataFrame:
    """Add the 0-based dense position of each row within ``keys``.

    Rows are ordered by the ``coarse`` columns, then by ``fine``. Counts per coarse
    value are summed first, so the only sort over rows happens inside one
    ``(keys, coarse)`` cell; a hot key, or no key at all, never lands in one task.
    Choose ``coarse`` so that a cell stays small and the first coarse column has few
    distinct values (dates, lengths, id blocks). Coarse columns must not be null.
    """
    keys, coarse = list(keys), list(coarse)
    cells = df.groupBy(*keys, *coarse).agg(F.count(F.lit(1)).alias("__n"))
    offsets = None
    for depth in range(1, len(coarse) + 1):
        path = keys + coarse[:depth]
        level = cells if depth == len(coarse) else cells.groupBy(*path).agg(F.sum("__n").alias("__n"))
        before = Window.partitionBy(*path[:-1]).orderBy(path[-1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*path, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(f"__o{depth}"))
        offsets = level if offsets is None or not path[:-1] else level.join(offsets, path[:-1])
    total = reduce(lambda a, b: a + b, [F.col(f"__o{d}") for d in range(1, len(coarse) + 1)])
    offsets = offsets.select(*keys, *coarse, total.alias("__off"))
    cell = Window.partitionBy(*keys, *coarse).orderBy(*fine)
    return (
        df.join(offsets, keys + coarse)
        .withColumn(name, F.row_number().over(cell) - F.lit(1).cast("long") + F.col("__off"))
        .drop("__off")
    )


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: str, block: int = 1024) -> DataFrame:
    """Replace ``value`` by its maximum over the rows of ``keys`` up to the row, by the integer column ``order``.

    Maxima of blocks of ``order`` are carried over first, so windows over rows stay
    inside one block and the window over blocks has one row for each.
    """
    keys, cell = list(keys), F.floor(F.col(order) / block)
    rows = df.withColumn("__cell", cell)
    tops = rows.groupBy(*keys, "__cell").agg(F.max(value).alias("__top"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "__cell", F.max("__top").over(before).alias("__before"))
    inside = Window.partitionBy(*keys, "__cell").orderBy(order)
    return (rows.join(tops, [*keys, "__cell"])
            .withColumn(value, F.coalesce(F.max(value).over(inside), F.col("__before"))).drop("__cell", "__before"))


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-key statistics (unique on ``keys``) back to their rows.

    Used in place of ``over (partition by key)`` where a key may be hot: the
    statistics combine map-side, and adaptive execution may split the hot
    probe partition, which it cannot do below a window.
    """
    return df.join(stats, list(keys), how)


def placed(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Place rows by ``keys``; their number of partitions is adaptive execution's unless given.

    Give one where rows are about to be exploded far beyond their present size, as
    partitions are sized by the bytes before the explosion.
    """
    return df.repartition(*keys) if partitions is None else df.repartition(partitions, *keys)
