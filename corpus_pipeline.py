"""From raw documents to packed training sequences: five stages, each written and read by the next.

SQL has no word for a trained classifier, so the pipeline has no oracle; its stages are
tested against brute force.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import quality
from tandem.llm.common import bitmap, bitmap_filter, free_name, row_key, saved
from tandem.llm.decontamination import benchmark_hits
from tandem.llm.exact_dedup import exact_groups
from tandem.llm.jaccard_join import similar_groups
from tandem.llm.packing import pack
from tandem.llm.queries import bpe_path, site_path

ORACLE_SQL = None


def _kept(docs: DataFrame, decisions: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, content, kept) keep; with ``once`` one of equal rows.

    Rows that are surely untouched pass straight through; only the others are shuffled.
    """
    key, drop_key, drop_id = (free_name(docs, x) for x in ("content", "drop_key", "drop_id"))
    each = saved(decisions.groupBy(F.col("content").alias(key), F.col("doc_id").alias("id"))
                 .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "decisions")
    touched = each.where(~F.col("kept") | (F.lit(once) & (F.col("n") > 1)))
    bits = bitmap(touched, key)
    named = docs.withColumn(key, row_key("doc_id", "text"))
    drop = each.where(~F.col("kept")).select(F.col(key).alias(drop_key), F.col("id").alias(drop_id))
    some = bitmap_filter(named, key, bits).join(
        drop, (F.col(key) == F.col(drop_key)) & F.col("doc_id").eqNullSafe(F.col(drop_id)), "left_anti")
    if once:
        some = some.dropDuplicates(["doc_id", key])
    return bitmap_filter(named, key, bits, keep=False).unionByName(some).drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their site hold for good."""
    models = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, quality.judge(docs, models, host="source", path=site_path()))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return _kept(docs, exact_groups(docs), once=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on shingles of five words at 0.8."""
    return _kept(docs, similar_groups(docs, n=5, threshold=0.8))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _kept(docs, hits.withColumn("kept", F.size("spans") == 0))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return pack(docs, bpe_path(), size=1024).drop("row")


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("near duplicates", near_stage),
          ("benchmark decontamination", benchmark_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i + 1 < len(STAGES):
            out = saved(out, "stage")
    return out
