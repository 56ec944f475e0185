"""N-gram bags and match statistics.

Sentences arrive as token arrays, one pair per row. Rows are placed by pair key once,
*before* the n-grams are exploded: the text moves, the roughly eight times larger
n-gram table does not, and both group-bys reuse that placement. The outer generators keep
Spark from testing ``size(array) > 0`` below them, which would build every array twice.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.arrays import ngrams, pad_ends
from tandem.scale import placed


def _grams(tokens: Column, orders: Sequence[int], **tags: Column) -> list[Column]:
    def tagged(n: int) -> Column:
        head = [F.lit(n).alias("n")]
        tail = [v.alias(k) for k, v in tags.items()]
        return F.transform(ngrams(tokens, n), lambda g: F.struct(*head, g.alias("gram"), *tail))

    return [tagged(n) for n in orders]


def ngram_counts(df: DataFrame, keys: Sequence[str], tokens: str, max_n: int = 4,
                 left: str | None = None, right: str | None = None) -> DataFrame:
    """``keys, n, gram, cnt``: the bag of n-grams of each row, optionally padded."""
    arrays = []
    for n in range(1, max_n + 1):
        t = pad_ends(F.col(tokens), n, left, right) if (left or right) else F.col(tokens)
        arrays += _grams(t, [n])
    rows = placed(df.select(*keys, tokens), keys).select(*keys, F.inline_outer(F.concat(*arrays)))
    rows = rows.filter(F.col("n").isNotNull())
    return rows.groupBy(*keys, "n", "gram").agg(F.count(F.lit(1)).alias("cnt"))


def bag_rows(pairs: DataFrame, keys: Sequence[str], hyp: str, ref: str, max_n: int = 4) -> DataFrame:
    """``keys, n, gram, h, r``: counts of each n-gram on both sides of a pair.

    ``n = 0`` carries the two lengths, so a pair too short for any n-gram keeps a row.
    """
    h, r, orders = F.col(hyp), F.col(ref), range(1, max_n + 1)
    one, none = F.lit(1), F.lit(0)
    lengths = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("gram"),
                               F.size(h).alias("h"), F.size(r).alias("r")))
    arrays = [lengths, *_grams(h, orders, h=one, r=none), *_grams(r, orders, h=none, r=one)]
    rows = placed(pairs.select(*keys, hyp, ref), keys).select(*keys, F.inline_outer(F.concat(*arrays)))
    return rows.groupBy(*keys, "n", "gram").agg(F.sum("h").alias("h"), F.sum("r").alias("r"))


def match_stats(pairs: DataFrame, keys: Sequence[str], hyp: str = "hyp", ref: str = "ref", max_n: int = 4,
                keywords: Sequence[str] | DataFrame = ()) -> DataFrame:
    """One row per pair: ``hyp_len, ref_len, m1..mN`` (clipped matches) and, with
    ``keywords``, ``k1`` (matched keywords) and ``ref_kw`` (keywords in the reference).
    ``keywords`` is a list, or a table with a ``keyword`` column."""
    bags = bag_rows(pairs, keys, hyp, ref, max_n)
    listed = not isinstance(keywords, DataFrame)
    if not listed:
        known = keywords.select(F.col("keyword").alias("gram"), F.lit(True).alias("kw")).distinct()
        bags = bags.join(known, "gram", "left")
    n = F.col("n")
    hit = F.least("h", "r")
    aggs = [F.max(F.when(n == 0, F.col("h"))).alias("hyp_len"), F.max(F.when(n == 0, F.col("r"))).alias("ref_len")]
    aggs += [F.sum(F.when(n == i, hit).otherwise(0)).alias(f"m{i}") for i in range(1, max_n + 1)]
    if not listed or keywords:
        kw = (n == 1) & (F.col("gram").isin(list(keywords)) if listed else F.coalesce("kw", F.lit(False)))
        aggs += [F.sum(F.when(kw, hit).otherwise(0)).alias("k1"),
                 F.sum(F.when(kw, F.col("r")).otherwise(0)).alias("ref_kw")]
    return bags.groupBy(*keys).agg(*aggs)


def multi_ref_bags(hyps: DataFrame, refs: DataFrame, keys: Sequence[str], hyp: str = "hyp", ref: str = "ref",
                   ref_no: str = "ref_no", max_n: int = 4) -> DataFrame:
    """``keys, n, gram, h, r`` where ``r`` is the largest count over all references."""
    tagged = hyps.select(*keys, F.lit(-1).cast("long").alias("ref_no"), F.col(hyp).alias("t")).unionByName(
        refs.select(*keys, F.col(ref_no).cast("long").alias("ref_no"), F.col(ref).alias("t")))
    arrays = _grams(F.col("t"), range(1, max_n + 1))
    counts = (
        placed(tagged, [*keys, "ref_no"]).select(*keys, "ref_no", F.inline_outer(F.concat(*arrays)))
        .filter(F.col("n").isNotNull())
        .groupBy(*keys, "ref_no", "n", "gram").agg(F.count(F.lit(1)).alias("cnt"))
    )
    is_hyp = F.col("ref_no") < 0
    return counts.groupBy(*keys, "n", "gram").agg(
        F.coalesce(F.max(F.when(is_hyp, F.col("cnt"))), F.lit(0)).alias("h"),
        F.coalesce(F.max(F.when(~is_hyp, F.col("cnt"))), F.lit(0)).alias("r"))


def multi_ref_stats(hyps: DataFrame, refs: DataFrame, keys: Sequence[str], hyp: str = "hyp", ref: str = "ref",
                    ref_no: str = "ref_no", max_n: int = 4, ref_len: str = "closest") -> DataFrame:
    """Match statistics against several references; ``ref_len`` is the ``closest``
    (ties: shorter), ``first`` (closest; ties: the first reference), ``shortest`` or ``average`` reference
    length. Hypotheses without a reference are left out; ``corpus.coverage`` counts them."""
    hits = multi_ref_bags(hyps, refs, keys, hyp, ref, ref_no, max_n).groupBy(*keys).agg(
        *[F.sum(F.when(F.col("n") == i, F.least("h", "r")).otherwise(0)).alias(f"m{i}")
          for i in range(1, max_n + 1)])
    lens = refs.select(*keys, F.size(ref).alias("__r"), F.col(ref_no).alias("__no")).join(
        hyps.select(*keys, F.size(hyp).alias("__h")), list(keys))
    # |difference| and length packed in one long, so that the minimum aggregates in place
    near = F.abs(F.col("__r") - F.col("__h")).cast("long") * (1 << 31) + F.col("__r")
    rule = {
        "closest": F.pmod(F.min(near), F.lit(1 << 31)),
        "first": F.min_by("__r", F.struct(F.abs(F.col("__r") - F.col("__h")), "__no")),
        "shortest": F.min("__r"),
        "average": F.sum("__r") / F.count(F.lit(1)),
    }[ref_len]
    lens = lens.groupBy(*keys).agg(F.max("__h").alias("hyp_len"), rule.alias("ref_len"))
    filled = lens.join(hits, list(keys), "left")
    return filled.select(*keys, "hyp_len", "ref_len",
                         *[F.coalesce(F.col(f"m{i}"), F.lit(0)).alias(f"m{i}") for i in range(1, max_n + 1)])


def bag_intersection(bags: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bag intersection with multiplicity, as rows with a positive common count."""
    return (bags.filter((F.col("n") > 0) & (F.col("h") > 0) & (F.col("r") > 0))
            .select(*by, "n", "gram", F.least("h", "r").alias("cnt")))


def bag_max_merge(df: DataFrame, keys: Sequence[str], ref_no: str, tokens: str, max_n: int = 4) -> DataFrame:
    """Largest count of each n-gram over the members of a group."""
    per_member = ngram_counts(df, [*keys, ref_no], tokens, max_n)
    return per_member.groupBy(*keys, "n", "gram").agg(F.max("cnt").alias("cnt"))
