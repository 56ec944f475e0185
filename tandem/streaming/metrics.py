"""Incremental metric counts: every micro-batch of scored pairs leaves a few small rows of
additive statistics, and the total is their sum whenever it is asked for."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tandem.operators.ngrams import match_stats
from tandem.operators.scores import corpus_stats


def write_counts(pairs: DataFrame, path: str, keys: Sequence[str], checkpoint: str, by: Sequence[str] = (),
                 hyp: str = "hyp", ref: str = "ref") -> StreamingQuery:
    """Start counting a stream of token pairs. A retried batch overwrites its own folder,
    so every batch is counted once."""

    def one(batch: DataFrame, batch_id: int) -> None:
        stats = match_stats(batch, [*by, *keys], hyp, ref)
        corpus_stats(stats, by).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (pairs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def total_counts(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of all batches; any score expression applies to it."""
    df = spark.read.parquet(path)
    sums = [c for c in df.columns if c not in {*by, "batch"}]
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


def live_counts(pairs: DataFrame, pair_id: str, at: str, delay: str, counts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A running table ``by, pairs, counts..`` over a stream of scored pairs; each pair counts once.

    A pair that is delivered again within ``delay`` of its time ``at`` is dropped by the state store, which forgets
    pairs beyond that; sums are kept per group, so the state is as large as the recent pairs and the groups.
    """
    once = pairs.withWatermark(at, delay).dropDuplicatesWithinWatermark([pair_id])
    return once.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), *[F.sum(c).alias(c) for c in counts])
