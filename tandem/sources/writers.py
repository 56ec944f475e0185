"""Sinks. Writes name their folders by column; a hot folder is still written by many tasks.

``mode`` is Spark's save mode; what is there already is kept unless it says otherwise.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = "errorifexists"


def write_jsonl(df: DataFrame, path: str, mode: str = KEEP) -> None:
    df.write.mode(mode).json(path)


def write_token_lines(df: DataFrame, tokens: str, path: str, mode: str = KEEP) -> None:
    df.filter(F.col(tokens).isNotNull()).select(F.array_join(tokens, " ").alias("value")).write.mode(mode).text(path)


def write_pairs(df: DataFrame, path: str, columns: Sequence[str] = ("pair_id", "source", "target"),
                mode: str = KEEP) -> None:
    """Aligned sides in one table; no two files to keep in step."""
    df.select(*columns).write.mode(mode).parquet(path)


def write_shards(df: DataFrame, path: str, by: Sequence[str] = ("split", "lang", "shard"), rows_per_file: int = 1_000_000,
                 mode: str = KEEP) -> None:
    """Token-id rows in one folder per ``by``; large folders get more tasks and files, by their size."""
    df.hint("rebalance", *by).write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def write_beams(df: DataFrame, path: str, mode: str = KEEP) -> None:
    df.write.mode(mode).partitionBy("beam").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int = 64, mode: str = KEEP) -> None:
    """A table of the catalog at ``path``, cut into ``buckets`` files by ``keys`` and sorted: joins by them need no shuffle.

    Tables that are to be joined need the same keys and number of buckets.
    """
    (df.repartition(buckets, *keys).write.mode(mode).format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
