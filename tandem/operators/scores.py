"""Scores as column expressions over match statistics.

``match_stats`` gives integers per pair; ``corpus_stats`` sums them (partial and final,
any grouping); the expressions below turn one row of sums into a score.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EPSILON = 0.1          # added to a zero match count
KEYWORD_WEIGHT = 1.0   # unigram weight of a keyword
OTHER_WEIGHT = 0.2     # unigram weight of any other token
RECALL_REF_LEN = 2     # reference length per pair in the keyword metric's brevity penalty
TINY = 2.2250738585072014e-308
ALPHA, K = 5, 5        # interpolation weight, length scale
UNIFORM = (0.25, 0.25, 0.25, 0.25)

# Keywords per language; other languages are read with ``sources.readers.keywords``.
KEYWORDS = {
    "java": """abstract assert boolean break byte case catch char class const continue default do double
        else enum extends final finally float for goto if implements import instanceof int interface long
        native new package private protected public return short static strictfp super switch synchronized
        this throw throws transient try void volatile while""".split(),
    "python": """False None True and as assert break class continue def del elif else except finally for
        from global if import in is lambda nonlocal not or pass raise return try while with yield""".split(),
}


def _sum(xs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def possible(length: Column, n: int) -> Column:
    return F.greatest(length - (n - 1), F.lit(0))


def corpus_stats(stats: DataFrame, by: Sequence[str] = (), max_n: int = 4, weighted: bool = False) -> DataFrame:
    """Additive statistics: ``pairs, hyp_len, ref_len`` and per order ``m`` matches,
    ``p`` possible n-grams, ``q`` the same with at least one per pair; ``weighted``
    adds fivefold recall sums ``wm1, wr1`` and ``r2..rN``."""
    h, r = F.col("hyp_len"), F.col("ref_len")
    aggs = [F.count(F.lit(1)).alias("pairs"), F.sum(h).alias("hyp_len"), F.sum(r).alias("ref_len")]
    for n in range(1, max_n + 1):
        aggs += [F.sum(f"m{n}").alias(f"m{n}"), F.sum(possible(h, n)).alias(f"p{n}"),
                 F.sum(F.greatest(possible(h, n), F.lit(1))).alias(f"q{n}")]
    if weighted:
        aggs += [F.sum(F.col("m1") + 4 * F.col("k1")).alias("wm1"),
                 F.sum(F.greatest(r + 4 * F.col("ref_kw"), F.lit(5))).alias("wr1")]
        aggs += [F.sum(F.greatest(possible(r, n), F.lit(1))).alias(f"r{n}") for n in range(2, max_n + 1)]
    return stats.groupBy(*by).agg(*aggs)


def recall_stats(per_reference: DataFrame, keys: Sequence[str], by: Sequence[str] = (), max_n: int = 4) -> DataFrame:
    """The columns ``bleu_recall`` needs, for several references per pair.

    ``per_reference`` is ``match_stats`` over one row per (pair, reference): matches and
    reference sizes add up over references, the hypothesis counts once.
    """
    r = F.col("ref_len")
    sums = {"wm1": F.col("m1") + 4 * F.col("k1"), "wr1": F.greatest(r + 4 * F.col("ref_kw"), F.lit(5)), "ref_len": r}
    for n in range(2, max_n + 1):
        sums[f"m{n}"], sums[f"r{n}"] = F.col(f"m{n}"), F.greatest(possible(r, n), F.lit(1))
    per_pair = per_reference.groupBy(*by, *keys).agg(
        F.max("hyp_len").alias("hyp_len"), *[F.sum(c).alias(n) for n, c in sums.items()])
    return per_pair.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.sum("hyp_len").alias("hyp_len"),
                                     *[F.sum(n).alias(n) for n in sums])


def sentence_stats(stats: DataFrame, keys: Sequence[str], max_n: int = 4) -> DataFrame:
    """The same columns for each pair alone; no aggregation."""
    cols = [F.col("hyp_len"), F.col("ref_len")]
    for n in range(1, max_n + 1):
        p = possible(F.col("hyp_len"), n)
        cols += [F.col(f"m{n}"), p.alias(f"p{n}"), F.greatest(p, F.lit(1)).alias(f"q{n}")]
    return stats.select(*keys, *cols)


def penalty(hyp: Column, ref: Column) -> Column:
    """1 above the reference length, 0 for an empty hypothesis."""
    return F.when(hyp > ref, F.lit(1.0)).when(hyp == 0, F.lit(0.0)).otherwise(F.exp(1 - F.try_divide(ref, hyp)))


def _geometric(precisions: Sequence[Column], weights: Sequence[float]) -> Column:
    return F.exp(_sum([F.lit(float(w)) * F.log(p) for w, p in zip(weights, precisions)]))


def bleu_smoothed(max_n: int = 4) -> Column:
    """Add one on every order; null where a length is zero."""
    precisions = [(F.col(f"m{n}") + 1) / (F.col(f"p{n}") + 1) for n in range(1, max_n + 1)]
    ratio = F.try_divide(F.col("hyp_len").cast("double"), F.col("ref_len").cast("double"))
    brevity = F.when(ratio > 1, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
    return _geometric(precisions, [1 / max_n] * max_n) * brevity


def bleu_epsilon(weights: Sequence[float] = UNIFORM, epsilon: float = EPSILON, auto_reweigh: bool = False) -> Column:
    """Zero matches count ``epsilon``; 0 without a single unigram match."""
    orders = range(1, len(weights) + 1)
    precisions = [F.when(F.col(f"m{n}") == 0, F.lit(epsilon)).otherwise(F.col(f"m{n}")) / F.col(f"q{n}")
                  for n in orders]
    mean = _geometric(precisions, weights)
    if auto_reweigh and tuple(weights) == UNIFORM:
        for k in (1, 2, 3):
            mean = F.when(F.col("hyp_len") == k, _geometric(precisions[:k], [1 / k] * k)).otherwise(mean)
    return F.when(F.col("m1") == 0, F.lit(0.0)).otherwise(penalty(F.col("hyp_len"), F.col("ref_len")) * mean)


def smoothed_precisions(method: int, max_n: int = 4) -> list[Column]:
    """The precisions under smoothing ``method`` 0..7; 5 and 7 need order ``max_n + 1``."""
    ms = [F.col(f"m{n}").cast("double") for n in range(1, max_n + 2)]
    qs = [F.col(f"q{n}").cast("double") for n in range(1, max_n + 2)]
    raw = [m / q for m, q in zip(ms, qs)]
    zero = [m == 0 for m in ms]
    size = F.col("hyp_len").cast("double")
    own = range(max_n)
    if method == 0:
        return [F.when(zero[i], F.lit(TINY)).otherwise(raw[i]) for i in own]
    if method == 1:
        return [F.when(zero[i], EPSILON / qs[i]).otherwise(raw[i]) for i in own]
    if method == 2:
        return [(ms[i] + 1) / (qs[i] + 1) for i in own]
    if method == 3:
        seen = [_sum([F.lit(1)] + [z.cast("int") for z in zero[:i]]) for i in own]
        return [F.when(zero[i], 1 / (F.pow(F.lit(2.0), seen[i]) * qs[i])).otherwise(raw[i]) for i in own]
    if method in (4, 7):
        scaled = [F.when(zero[i] & (size != 0), (i + F.try_divide(F.lit(float(K)), F.log(size))) / qs[i])
                  .otherwise(raw[i]) for i in own]
        if method == 4:
            return scaled
        raw = scaled + raw[max_n:]
    if method in (5, 7):
        out, left = [], raw[0] + 1
        for i in own:
            left = (left + raw[i] + raw[i + 1]) / 3
            out.append(left)
        return out
    if method == 6:
        out = raw[:2]
        for i in range(2, max_n):
            prior = F.when(out[i - 2] == 0, F.lit(0.0)).otherwise(F.try_divide(out[i - 1] * out[i - 1], out[i - 2]))
            out.append((ms[i] + ALPHA * prior) / (possible(size, i + 1) + ALPHA))
        return [F.when(~zero[2], p) for p in out]
    raise ValueError(f"unknown smoothing method {method}")


def bleu_with_smoothing(method: int, weights: Sequence[float] = UNIFORM) -> Column:
    mean = _geometric(smoothed_precisions(method, len(weights)), weights)
    return F.when(F.col("m1") == 0, F.lit(0.0)).otherwise(penalty(F.col("hyp_len"), F.col("ref_len")) * mean)


def bleu_recall(weights: Sequence[float] = UNIFORM, true_ref_len: bool = False) -> Column:
    """Keyword-weighted recall over ``corpus_stats(weighted=True)``."""
    nums = [F.col("wm1")] + [F.col(f"m{n}") for n in range(2, len(weights) + 1)]
    dens = [F.col("wr1")] + [F.col(f"r{n}") for n in range(2, len(weights) + 1)]
    # the fivefold unigram sums cancel, except against epsilon, which is never reached for them
    parts = [F.when(a == 0, F.lit(EPSILON)).otherwise(a) / b for a, b in zip(nums, dens)]
    ref = F.col("ref_len") if true_ref_len else F.col("pairs") * RECALL_REF_LEN
    return F.when(F.col("wm1") == 0, F.lit(0.0)).otherwise(
        penalty(F.col("hyp_len"), ref) * _geometric(parts, weights))


def bleu_plain(max_n: int = 4) -> Column:
    """No smoothing: any order without a match gives 0. Scaled to 100."""
    orders = range(1, max_n + 1)
    none = reduce(lambda a, b: a | b, [F.col(f"m{n}") == 0 for n in orders])
    h, r = F.col("hyp_len"), F.col("ref_len")
    brevity = F.when(h < r, F.exp(1 - F.try_divide(r, h))).otherwise(F.lit(1.0))
    mean = _geometric([F.try_divide(F.col(f"m{n}"), F.col(f"p{n}")) for n in orders], [1 / max_n] * max_n)
    return F.when(none | (r == 0), F.lit(0.0)).otherwise(100 * brevity * mean)


def bleu_exponential(max_n: int = 4) -> Column:
    """Each further order without a match halves the pretended precision. Scaled to 100."""
    seen, logs, alive = F.lit(0), [], F.lit(True)
    for n in range(1, max_n + 1):
        m, p = F.col(f"m{n}"), F.col(f"p{n}")
        alive = alive & (p > 0)
        seen = seen + (m == 0).cast("int")
        precision = F.when(m == 0, F.try_divide(F.lit(100.0), F.pow(F.lit(2.0), seen) * p)).otherwise(
            F.try_divide(100.0 * m, p))
        logs.append(F.when(alive, F.log(precision)))
    h, r = F.col("hyp_len"), F.col("ref_len")
    brevity = F.when(h >= r, F.lit(1.0)).when(h == 0, F.lit(0.0)).otherwise(F.exp(1 - F.try_divide(r, h)))
    return F.coalesce(brevity * F.exp(_sum(logs) / max_n), F.lit(0.0))


def nl_scores(max_n: int = 4) -> list[Column]:
    """Per-pair natural-language scores ``bleu, bleu_1..bleu_N`` in [0, 1]."""
    parts, singles = [], []
    for n in range(1, max_n + 1):
        a = 0 if n == 1 else 1
        m, p = F.col(f"m{n}").cast("double"), F.col(f"p{n}").cast("double")
        parts.append(F.log(m + a + TINY) - F.log(p + a + TINY))
        singles.append(F.when(p == 0, F.lit(0.0)).otherwise(F.exp(F.log(m + TINY) - F.log(p))))
    brevity = F.least(F.lit(0.0), 1 - (F.col("ref_len") + 1) / (F.col("hyp_len") + 1))
    whole = F.exp(_sum(parts) / max_n + brevity)
    return [whole.alias("bleu"), *[s.alias(f"bleu_{i}") for i, s in enumerate(singles, 1)]]


def exact_match(hyp: Column, ref: Column) -> Column:
    return 100.0 * F.sum((hyp == ref).cast("long")) / F.count(F.lit(1))


def overlap(items: DataFrame, keys: Sequence[str], item: Sequence[str], by: Sequence[str] = (),
            membership: bool = False) -> DataFrame:
    """``matched, total`` of reference items found on the hypothesis side.

    ``items`` holds one row per item with ``side`` in ``hyp``/``ref``. With
    ``membership`` a hypothesis item matches any number of equal reference items;
    otherwise each is used once.
    """
    h = F.sum((F.col("side") == "hyp").cast("long"))
    r = F.sum((F.col("side") == "ref").cast("long"))
    cells = items.groupBy(*keys, *item).agg(h.alias("h"), r.alias("r"))
    hit = F.when(F.col("h") > 0, F.col("r")).otherwise(0) if membership else F.least("h", "r")
    return cells.groupBy(*by).agg(F.sum(hit).alias("matched"), F.sum("r").alias("total"))


def overlap_score(empty: float | None = None) -> Column:
    """matched / total; ``empty`` where there is nothing to match."""
    score = F.try_divide(F.col("matched").cast("double"), F.col("total").cast("double"))
    return score if empty is None else F.coalesce(score, F.lit(empty))


def composite(metrics: DataFrame, weights: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Weighted sum over a tidy ``(metric, value)`` table."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return metrics.groupBy(*by).agg(
        F.sum(F.coalesce(F.try_element_at(table, F.col("metric")), F.lit(0.0)) * F.col("value")).alias("composite"))


def report(metrics: DataFrame, names: Sequence[str], weights: dict[str, float]) -> DataFrame:
    """A one-row-per-metric table with the weighted ``composite`` added, in one pass."""
    wide = metrics.groupBy().agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    whole = _sum([F.lit(w) * F.col(m) for m, w in weights.items()])
    return wide.withColumn("composite", whole).unpivot([], [*names, "composite"], "metric", "value")


def tidy(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(metrics), "metric", "value")


def best_over_beams(df: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Best value of each metric, independently of the others."""
    return df.groupBy(*by).agg(F.max("value").alias("value"))
