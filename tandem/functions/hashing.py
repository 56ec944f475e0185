"""Seeded pseudo-random columns.

A value depends only on the seed and the given integers, never on partitioning or
task order, and the arithmetic is plain enough to repeat in any SQL dialect.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def _scramble(h: Column) -> Column:
    return F.pmod(h * (h + 48271) + 11, F.lit(PRIME).cast("long"))


def state(seed: int, *ids: Column) -> Column:
    """A whole number in ``[0, PRIME)``; all products stay below 2**63."""
    h = F.lit(seed % PRIME).cast("long")
    for x in ids:
        h = _scramble(F.pmod(h + F.pmod(x.cast("long"), F.lit(PRIME).cast("long")) * 16807, F.lit(PRIME).cast("long")))
    return h


def uniform(seed: int, *ids: Column) -> Column:
    """A double in ``[0, 1)``."""
    return state(seed, *ids).cast("double") / F.lit(float(PRIME))


def state_sql(seed: int, *ids: str) -> str:
    h = str(seed % PRIME)
    for x in ids:
        y = f"(({h} + (({x})::BIGINT % {PRIME}) * 16807) % {PRIME})"
        h = f"(({y} * ({y} + 48271) + 11) % {PRIME})"
    return h


def uniform_sql(seed: int, *ids: str) -> str:
    return f"({state_sql(seed, *ids)}::DOUBLE / {PRIME}.0)"
