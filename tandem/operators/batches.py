"""Training tables: order, batches, padding, mixing and sampling of data sets."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.arrays import pad, shift_right
from tandem.functions.hashing import state, uniform
from tandem.scale import attach, ranked


BLOCKS = ["__block", "__subblock"]


def _id_blocks(df: DataFrame, row_id: str, size: int = 4096) -> DataFrame:
    """Two levels of id blocks, so that neither has many blocks per level nor many rows per block."""
    return (df.withColumn("__block", F.floor(F.col(row_id) / (size * size)))
            .withColumn("__subblock", F.floor(F.col(row_id) / size)))


def batch_order(df: DataFrame, row_id: str, src_len: str, tgt_len: str, seed: int | None = None,
                cells: int = 1024) -> DataFrame:
    """Dense ``position`` by source length, then target length, then a seeded draw
    (or the row id, without ``seed``)."""
    if seed is None:
        marked = _id_blocks(df.withColumn("__u", F.lit(0)), row_id)
        cell = BLOCKS
    else:
        marked = df.withColumn("__u", uniform(seed, F.col(row_id)))
        marked = marked.withColumn("__cell", F.floor(F.col("__u") * cells))
        cell = ["__cell"]
    return ranked(marked, [], [src_len, tgt_len, *cell], ["__u", row_id], "position").drop("__u", *cell)


def batches(df: DataFrame, size: int, position: str = "position") -> DataFrame:
    return df.withColumn("batch_id", F.floor(F.col(position) / size).cast("long"))


def sort_in_batch(df: DataFrame, src_len: str, position: str = "position") -> DataFrame:
    """Row number within a batch by falling source length; a batch is of fixed size."""
    w = Window.partitionBy("batch_id").orderBy(F.desc(src_len), position)
    return df.withColumn("slot", F.row_number().over(w) - 1)


def length_buckets(df: DataFrame, length: str, n: int, name: str = "bucket") -> DataFrame:
    """Padded length: the smallest of ``n`` quantile bounds not below the length.

    Exact, from the histogram of lengths: its windows see one row per distinct length.
    """
    # the join is with at most n bounds
    hist = df.groupBy(length).agg(F.count(F.lit(1)).alias("cnt"))
    upto = Window.orderBy(length).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("cnt").over(Window.partitionBy())
    hist = hist.withColumn("hi", F.sum("cnt").over(upto)).withColumn("total", total)
    ranks = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.floor(i * (F.col("total") - 1) / n))
    bound = F.exists(ranks, lambda r: (r >= F.col("hi") - F.col("cnt")) & (r < F.col("hi")))
    bounds = hist.filter(bound).select(F.col(length).alias(name))
    below = F.coalesce(F.lag(name).over(Window.orderBy(name)), F.lit(-1))
    bounds = bounds.withColumn("__below", below)
    return df.join(F.broadcast(bounds), (F.col(length) > F.col("__below")) & (F.col(length) <= F.col(name))).drop(
        "__below")


def pad_batch(df: DataFrame, tokens: str, symbol: Column, left: bool) -> DataFrame:
    """Pad to the longest row of the batch."""
    width = F.max(F.size(tokens)).over(Window.partitionBy("batch_id"))
    return df.withColumn("__w", width).withColumn(tokens, pad(F.col(tokens), F.col("__w"), symbol, left)).drop("__w")


def batch_table(df: DataFrame, row_id: str, src: str, tgt: str, symbol: Column) -> DataFrame:
    """One row per batch: ids, counts and padded arrays, longest source first."""
    cell = F.struct((-F.size(src)).alias("k"), F.col("position").alias("p"), F.col(row_id).alias("id"),
                    F.col(src).alias("src"), F.col(tgt).alias("tgt"))
    rows = df.groupBy("batch_id").agg(F.array_sort(F.collect_list(cell)).alias("r"),
                                      F.max(F.size(src)).alias("sw"), F.max(F.size(tgt)).alias("tw"),
                                      F.count(F.lit(1)).alias("nsentences"), F.sum(F.size(tgt)).alias("ntokens"))

    def column(fn) -> Column:
        return F.transform("r", fn)

    return rows.select(
        "batch_id", column(lambda x: x["id"]).alias("ids"), "nsentences", "ntokens",
        column(lambda x: F.size(x["src"])).alias("src_lengths"),
        column(lambda x: pad(x["src"], F.col("sw"), symbol, True)).alias("src_tokens"),
        column(lambda x: pad(x["tgt"], F.col("tw"), symbol, False)).alias("target"),
        column(lambda x: pad(shift_right(x["tgt"]), F.col("tw"), symbol, False)).alias("prev_output_tokens"))


def alignment_weights(df: DataFrame, keys: Sequence[str], tgt: str) -> DataFrame:
    """Weight of an alignment: one over the number sharing its target."""
    # a group holds tokens of one sentence, so a window is safe
    return df.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy(*keys, tgt)))


# ---- mixing data sets -----------------------------------------------------

def epoch_shard(n_shards: int | Column, epoch: Column) -> Column:
    """Shard read in an epoch; epochs count from 1."""
    return F.pmod(epoch - 1, F.lit(n_shards))


def upsample_concat(primary: DataFrame, others: Sequence[DataFrame], times: int) -> DataFrame:
    """The primary data set ``times`` times, then the others once, with a ``copy`` number."""
    out = primary.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    for o in others:
        out = out.unionByName(o.withColumn("copy", F.lit(1)))
    return out


def round_robin_zip(df: DataFrame, lang: str, langs: Sequence[str], row_id: str) -> DataFrame:
    """``step, lang, row``: at every step one row of each data set, shorter ones starting over.

    The steps are the row numbers of the longest data set, so they are as spread out as its rows.
    """
    rows = df.select(lang, row_id).filter(F.col(lang).isin(list(langs)))
    placed = ranked(_id_blocks(rows, row_id), [lang], BLOCKS, [row_id], "pos").select(lang, row_id, "pos")
    # one row per given language: a proven bound for the two broadcasts
    sizes = rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n"))
    longest = F.broadcast(sizes.orderBy(F.desc("n"), lang).limit(1).select(lang))
    steps = placed.join(longest, lang, "left_semi").select(F.col("pos").alias("step"))
    wanted = steps.withColumn(lang, F.explode(F.array(*[F.lit(x) for x in langs])))
    wanted = wanted.join(F.broadcast(sizes), lang).select("step", lang, (F.col("step") % F.col("n")).alias("pos"))
    return attach(wanted, placed, [lang, "pos"]).select("step", lang, F.col(row_id).alias("row"))


def sampling_probs(df: DataFrame, lang: str, coefficient: float) -> DataFrame:
    """``lang, n, p``: shares raised to ``coefficient`` and renormalized; one row per language."""
    everything = Window.partitionBy()
    n = df.groupBy(lang).agg(F.count(F.lit(1)).alias("n"))
    raised = n.withColumn("w", F.pow(F.col("n") / F.sum("n").over(everything), F.lit(coefficient)))
    return raised.select(lang, "n", (F.col("w") / F.sum("w").over(everything)).alias("p"))


def weighted_draw(rows: DataFrame, row_id: str, probs: DataFrame, lang: str, langs: Sequence[str], seed: int,
                  name: str = "drawn") -> DataFrame:
    """Draw one of ``langs`` per row; their table has one row each and is matched by range."""
    probs = probs.filter(F.col(lang).isin(list(langs)))
    probs = probs.select(lang, (F.col("p") / F.sum("p").over(Window.partitionBy())).alias("p"))
    w = Window.orderBy(lang)
    upto = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.lead(lang).over(w).isNull()
    edges = probs.select(F.col(lang).alias(name), (upto - F.col("p")).alias("lo"),
                         F.when(last, F.lit(2.0)).otherwise(upto).alias("hi"))
    edges = edges.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy(name)), F.lit(0.0)))
    u = uniform(seed, F.col(row_id))
    drawn = rows.withColumn("__u", u)
    return drawn.join(F.broadcast(edges), (F.col("__u") >= F.col("lo")) & (F.col("__u") < F.col("hi"))).drop("__u", "lo", "hi")


def pool_probs(df: DataFrame, pool: str, item: str, coefficient: float) -> DataFrame:
    """``pool, item, n, p``: each pool's items by their own shares, raised to ``coefficient``; -1 turns weighting off.

    One row for each item of a pool (a language, a language pair).
    """
    if coefficient != -1 and coefficient <= 0:
        raise ValueError("the coefficient is -1 or positive")
    whole = Window.partitionBy(pool)
    n = df.groupBy(pool, item).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(1.0) if coefficient == -1 else F.pow(F.col("n") / F.sum("n").over(whole), F.lit(coefficient))
    raised = n.withColumn("w", weight)
    return raised.select(pool, item, "n", (F.col("w") / F.sum("w").over(whole)).alias("p"))


def race_draws(rows: DataFrame, row_id: str, probs: DataFrame, item: str, items: Sequence[str], n: int, seed: int,
               replace: bool = True) -> DataFrame:
    """``row_id, draw, item``: ``n`` weighted draws of ``items`` for each row, at most as many as there are items.

    An item's arrival is exponential with its probability as rate, and the first to arrive is drawn. With
    replacement every draw has a race of its own; without, the first ``n`` of one race are drawn in order.
    ``probs`` (item, p) is joined by item; items without a row there, or with no probability, never arrive.
    """
    known = probs.select(F.col(item), F.col("p")).filter(F.col(item).isin(list(items)) & (F.col("p") > 0))
    n = min(n, len(items))
    draws = F.sequence(F.lit(0), F.lit(n - 1 if replace else 0))
    entrants = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(x).alias(item)) for i, x in enumerate(items)])
    each = rows.select(row_id, F.explode(draws).alias("draw")).select(row_id, "draw", F.inline(entrants))
    arrival = -F.log(1 - uniform(seed, F.col(row_id), F.col("draw") * len(items) + F.col("no"))) / F.col("p")
    each = each.join(F.broadcast(known), item).withColumn("arrival", arrival)  # a row for each of the items given
    if replace:
        return each.groupBy(row_id, "draw").agg(F.min_by(item, F.struct("arrival", "no")).alias(item))
    order = Window.partitionBy(row_id).orderBy("arrival", "no")
    ranked_ = each.withColumn("draw", F.row_number().over(order) - 1)
    return ranked_.filter(F.col("draw") < n).select(row_id, "draw", item)


def permuted(position: Column, n: Column, seed: int, rounds: int = 48) -> Column:
    """A keyed bijection of 0 .. n - 1: the place of a row in a random order, without a sort.

    In each round a position and its mirror at a drawn point either change places or not, by a draw that both
    have in common, so every round is its own inverse for any ``n``.
    """
    def one(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(state(seed, r), n) - x, n)
        return F.when(state(seed + 1, r, F.greatest(x, mirror)) % 2 == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(rounds - 1).cast("bigint")), position.cast("bigint"), one)


def other_lang(lang: Column, langs: Sequence[str], seed: int, row_id: Column) -> Column:
    """A language other than the row's own, all equally likely."""
    rest = F.filter(F.array(*[F.lit(x) for x in langs]), lambda x: x != lang)
    return F.get(rest, F.pmod(state(seed, row_id), F.size(rest)).cast("int"))


def every_kth(df: DataFrame, lang: str, row_id: str, k: int) -> DataFrame:
    """Every ``k``-th row of each language in id order."""
    placed = ranked(_id_blocks(df, row_id), [lang], BLOCKS, [row_id], "pos")
    return placed.filter((F.col("pos") + 1) % k == 0).drop(*BLOCKS)


def concat_pair(a: Column, b: Column, a_lang: Column, b_lang: Column, reset_positions: bool) -> Column:
    """Two sequences in one, with positions and language ids. Without a reset the end
    mark of the first is overwritten by the start mark of the second."""
    cut = F.size(a) if reset_positions else F.size(a) - 1
    tokens = F.concat(F.slice(a, F.lit(1), cut), b)
    index = F.sequence(F.lit(0), F.size(tokens) - 1)
    places = F.transform(index, lambda i: F.when(i >= cut, i - F.size(a)).otherwise(i)) if reset_positions else index
    langs = F.transform(index, lambda i: F.when(i >= cut, b_lang).otherwise(a_lang))
    return F.struct(tokens.alias("tokens"), places.alias("positions"), langs.alias("langs"))


def schedule(step: Column, config: Sequence[tuple[int, float]]) -> Column:
    """Piecewise-linear value; constant after the last point, null before the first."""
    out = None
    for (xa, ya), (xb, yb) in zip(config, config[1:]):
        inside = (step >= xa) & (step < xb)
        value = F.lit(float(ya)) + (step - xa) * (float(yb - ya) / float(xb - xa))
        out = F.when(inside, value) if out is None else out.when(inside, value)
    last = step >= config[-1][0]
    value = F.lit(float(config[-1][1]))
    return F.when(last, value) if out is None else out.when(last, value)


def parse_schedule(text: str) -> list[tuple[int, float]]:
    """``"0:1,1000:0"`` as points; a single number is a constant."""
    if ":" not in text:
        return [(0, float(text))]
    points = [(int(k), float(v)) for k, v in (p.split(":") for p in text.split(","))]
    if any(a[0] >= b[0] for a, b in zip(points, points[1:])):
        raise ValueError(f"steps must rise: {text}")
    return points
