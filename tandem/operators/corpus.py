"""Corpus preparation: selection, field choice, length policies, vocabulary."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import docstring_tokens, squeeze, strip
from tandem.scale import placed, ranked


def select_submissions(subs: DataFrame, meta: DataFrame, ignored: DataFrame, outliers: DataFrame,
                       representatives: DataFrame, category: str = "all") -> DataFrame:
    """Submissions outside ignored problems and outlier lists that represent their
    cluster, optionally of one status.

    The lists are applied to bare ids; the code is joined once, to the ids that remain.
    """
    keys = ["problem_id", "submission_id"]
    kept = (subs.select(*keys)
            .join(ignored, "problem_id", "left_anti")
            .join(outliers, "submission_id", "left_anti")
            .join(representatives, "submission_id", "left_semi"))
    if category != "all":
        kept = kept.join(meta.filter(F.col("status") == category).select(*keys), keys, "left_semi")
    return subs.filter(F.length("code") > 0).join(kept, keys, "left_semi")


def missing_metadata(subs: DataFrame, meta: DataFrame) -> DataFrame:
    return subs.join(meta, ["problem_id", "submission_id"], "left_anti")


def representatives(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """The first id of every group of equal texts; only digests are shuffled."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("digest")).agg(F.min(row_id).alias(row_id)).select(row_id)


def docstring(tokens: Column, summary: Column) -> Column:
    """Given tokens, else the tokenized summary, as one squeezed line; null when both are missing."""
    return squeeze(F.coalesce(F.array_join(tokens, " "), F.array_join(docstring_tokens(summary), " ")))


def code_field(code: Column, function: Column) -> Column:
    return F.coalesce(code, function)


def non_empty(*cols: str) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.length(F.col(c)) > 0)
    return cond


REASONS = ["EMPTY", "OVER_LENGTH"]


def length_policy(df: DataFrame, tokens: Sequence[str], texts: Sequence[str], max_len: int = 510,
                  strict: bool = False, keep_empty: bool = False) -> DataFrame:
    """Add ``reason`` (``PASS``, ``EMPTY`` or ``OVER_LENGTH``) and cut tokens to ``max_len``.

    All sides pass or fail together; ``EMPTY`` looks at the stripped ``texts``.
    """
    empty, over = F.lit(False), F.lit(False)
    for t, x in zip(tokens, texts):
        empty = empty | (strip(F.col(x)) == "")
        over = over | (F.size(t) > max_len)
    reason = F.when(empty & F.lit(not keep_empty), "EMPTY").when(over & F.lit(strict), "OVER_LENGTH").otherwise("PASS")
    out = df.withColumn("reason", reason)
    for t in tokens:
        out = out.withColumn(t, F.when(F.col("reason") == "PASS", F.slice(t, 1, max_len)))
    return out


def filter_reasons(df: DataFrame) -> DataFrame:
    """``num_filtered_<reason>`` counts, most common first."""
    names = {f"num_filtered_{r}": F.count_if(F.col("reason") == r) for r in REASONS}
    wide = df.agg(*[c.alias(n) for n, c in names.items()])
    return wide.unpivot([], list(names), "reason", "n").filter(F.col("n") > 0).orderBy(F.desc("n"), "reason")


# Prefix sizes of the train, valid and test splits.
HEAD_SIZES = {"train": 90000, "valid": 2500, "test": 2781}


def head_splits(df: DataFrame, row_no: str, sizes: dict[str, int] = HEAD_SIZES) -> DataFrame:
    """Membership flags of overlapping prefix splits; ``row_no`` counts from 0."""
    return df.withColumns({f"in_{s}": F.col(row_no) < n for s, n in sizes.items()})


def hash_split(draw: Column, shares: dict[str, float]) -> Column:
    """Disjoint splits from a uniform draw per text."""
    out, edge = None, 0.0
    for name, share in shares.items():
        edge += share
        out = F.when(draw < edge, F.lit(name)) if out is None else out.when(draw < edge, F.lit(name))
    return out.otherwise(F.lit(list(shares)[-1]))


def split_overlap(df: DataFrame, text: str, split: str, names: Sequence[str]) -> DataFrame:
    """Texts shared by each pair of splits, by digest; one group-by, no self-join."""
    flags = [F.max(F.col(split) == n).alias(n) for n in names]
    seen = df.groupBy(F.sha2(F.col(text), 256).alias("digest")).agg(*flags)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    sums = seen.agg(*[F.coalesce(F.sum((F.col(a) & F.col(b)).cast("long")), F.lit(0)).alias(f"{a}/{b}")
                      for a, b in pairs])
    return sums.unpivot([], [f"{a}/{b}" for a, b in pairs], "splits", "texts")


def alignment(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of keys on either side and on both; scoring needs ``aligned``."""
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per_key = tagged.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    both = ((F.col("l") > 0) & (F.col("r") > 0)).cast("long")
    out = per_key.agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.sum(both).alias("both"),
                      F.max(F.col("l") != F.col("r")).alias("uneven"))
    return out.select("left_rows", "right_rows", "both", (~F.col("uneven")).alias("aligned"))


def coverage(hyps: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``scored, only_hyp, only_ref``: ids on both sides and on one only, however many references an id has."""
    ids = hyps.select(*keys, F.lit(True).alias("h"), F.lit(False).alias("r")).unionByName(
        refs.select(*keys, F.lit(False).alias("h"), F.lit(True).alias("r")))
    each = ids.groupBy(*keys).agg(F.max("h").alias("h"), F.max("r").alias("r"))
    return each.agg(F.count_if(F.col("h") & F.col("r")).alias("scored"), F.count_if(~F.col("r")).alias("only_hyp"),
                    F.count_if(~F.col("h")).alias("only_ref"))


# ---- vocabulary -----------------------------------------------------------

UNKNOWN, FIRST_ID = 3, 4  # Fixed values: ids 0..3 are the special tokens.


def build_vocabulary(df: DataFrame, tokens: str, min_count: int = 2) -> DataFrame:
    """``token, cnt, token_id`` by falling count, then token.

    Ids come from counts per count and beginning of the token, up to its fifth
    character: no sort over the whole vocabulary in one task, nor over all rare tokens.
    """
    counts = (df.select(F.explode_outer(tokens).alias("token")).filter(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
              .filter(F.col("cnt") >= min_count)
              .withColumn("__c", -F.col("cnt")).withColumn("__a", F.substring("token", 1, 1))
              .withColumn("__b", F.substring("token", 2, 1)).withColumn("__d", F.substring("token", 3, 3)))
    return ranked(counts, [], ["__c", "__a", "__b", "__d"], ["token"], "token_id").select(
        "token", "cnt", (F.col("token_id") + FIRST_ID).alias("token_id"))


def numericalize(df: DataFrame, row_id: str, tokens: str, vocab: DataFrame) -> DataFrame:
    """Token ids in order, out-of-vocabulary tokens as ``UNKNOWN``; a row without tokens has none.

    A row's repeated tokens are one cell with all their positions, made where the row is
    placed. A vocabulary under the broadcast threshold is looked up in place. A larger one
    is joined by token, where adaptive execution splits the partition of a frequent token.
    """
    each = placed(df.select(row_id, tokens), [row_id]).select(row_id, F.posexplode_outer(tokens).alias("pos", "token"))
    cells = each.groupBy(row_id, "token").agg(F.collect_list("pos").alias("at"))
    found = cells.join(vocab.select("token", "token_id"), "token", "left").select(
        row_id, F.transform("at", lambda p: F.struct(
            p.alias("pos"), F.coalesce(F.col("token_id"), F.lit(UNKNOWN)).alias("id"))).alias("cells"))
    ids = found.groupBy(row_id).agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))
    return ids.select(row_id, F.transform("cells", lambda c: c["id"]).alias("ids"))
