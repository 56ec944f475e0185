"""Document quality: a text classifier's evidence joined with what its host and path say.

A logistic model over word features and text statistics gives each document evidence.
The share of good documents is estimated for every host and, within it, every path;
sparse ones are shrunk towards the level above by beta priors whose strength is fitted to
how much hosts (paths) really differ. The document's posterior is its evidence with the
path's posterior in place of the global prior.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm import words as W
from tandem.llm.common import as_bytes, buffers, ints, lists, mapped, pieces, row_key, saved

_HASH_BITS = 18
_FEATURES = 2 << _HASH_BITS  # words, then beginnings of words
_STATS = 9
_KINDS = [b"#$%&*@^~=+<>", b"!?", b"|\t", bytes(range(65, 91)), b"0123456789", b".,;:"]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) of the distinct word features of each text, statistics [texts, 9], word counts.

    A feature is a hashed word or the hashed first six bytes of one. Statistics are shares
    of kinds of characters, of repeated words and of words equal to the one before.
    """
    w, n = W.words(data, offsets, W.ALNUM), len(offsets) - 1
    mask = np.uint64((1 << _HASH_BITS) - 1)
    heads = W.span_hashes(W.ALNUM[data], w.start, np.minimum(w.end, w.start + 6))
    keys = np.concatenate([w.doc << 20 | (w.hash & mask).astype(np.int64),
                           w.doc << 20 | (heads & mask).astype(np.int64) | 1 << _HASH_BITS])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    size, words = np.maximum(np.diff(offsets), 1), np.maximum(w.counts, 1)
    stats = np.zeros((n, _STATS), np.float32)
    for i, kind in enumerate(_KINDS):
        table = np.zeros(256, bool)
        table[list(kind)] = True
        sums = np.concatenate([[0], np.cumsum(table[data])])
        stats[:, i] = (sums[offsets[1:]] - sums[offsets[:-1]]) / size
    if len(w.hash):
        same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
        stats[:, 6] = np.bincount(w.doc[1:][same], minlength=n) / words
        order = np.lexsort((w.hash, w.doc))
        h, d = w.hash[order], w.doc[order]
        again = d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])]
        stats[:, 7] = np.bincount(again, minlength=n) / words
        stats[:, 8] = np.bincount(w.doc, weights=w.end - w.start, minlength=n) / words / 20
    return keys >> 20, keys & ((1 << 20) - 1), stats, w.counts


def shaped(stats: np.ndarray) -> np.ndarray:
    """Statistics as inputs of a linear model: themselves and two clipped steps of each."""
    return np.concatenate([stats, np.minimum(stats * 5, 1), np.minimum(stats * 40, 1)], 1)


class Linear:
    """A logistic model: weights of the word features (0 for most) and of the statistics."""

    def __init__(self, words: np.ndarray, stats: np.ndarray, bias: float, mean: np.ndarray):
        self.words, self.stats, self.bias, self.mean = words, stats, bias, mean

    def logits(self, doc: np.ndarray, feature: np.ndarray, stats: np.ndarray) -> np.ndarray:
        sums = np.bincount(doc, weights=self.words[feature], minlength=len(stats))
        return sums + (shaped(stats) - self.mean) @ self.stats + self.bias


def fit_linear(doc: np.ndarray, feature: np.ndarray, stats: np.ndarray, gold: np.ndarray, steps: int = 200,
               penalty: float = 1e-4, doubt: float = 3.0) -> Linear:
    """Logistic regression on the word features and the statistics.

    A feature that is z deviations more frequent in one class than chance has it is scaled by
    ``1 - (doubt / z)**2``, and by 0 below ``doubt``: the penalty then holds down what little evidence
    there is for, and there is no limit to how many features count. With one class only the model
    is that class's constant.
    """
    n = len(gold)
    good = float(gold.mean()) if n else 1.0
    if n == 0 or good in (0.0, 1.0):
        return constant(good)
    weight = feature_weights(np.bincount(feature, weights=gold[doc], minlength=_FEATURES),
                             np.bincount(feature, minlength=_FEATURES), good, doubt)
    some = weight[feature] > 0
    return fit_weighted(doc[some], feature[some], stats, gold, weight, steps, penalty)


def constant(good: float) -> Linear:
    """The model of a single class, or of none: that class's constant."""
    return Linear(np.zeros(_FEATURES), np.zeros(3 * _STATS), 3.0 if good == 1 else -3.0, np.zeros(3 * _STATS))


def feature_weights(hits: np.ndarray, total: np.ndarray, good: float, doubt: float = 3.0) -> np.ndarray:
    """The scale of each feature from its count in good documents and in all, as ``fit_linear`` has it."""
    z = np.abs(hits - total * good) / np.sqrt(total * good * (1 - good) + 1)
    return 1 - (doubt / np.maximum(z, doubt)) ** 2


def fit_weighted(doc: np.ndarray, feature: np.ndarray, stats: np.ndarray, gold: np.ndarray, weight: np.ndarray,
                 steps: int = 200, penalty: float = 1e-4) -> Linear:
    """``fit_linear`` on the (doc, feature) pairs whose feature has a positive ``weight``, those only given."""
    n = len(gold)
    good = float(gold.mean())
    chosen, column = np.unique(feature, return_inverse=True)
    value = weight[feature]
    mean = shaped(stats).mean(0)
    x = shaped(stats) - mean
    size = len(chosen)
    w, b = np.zeros(size + x.shape[1]), np.log(good / (1 - good))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(doc, weights=w[column] * value, minlength=n) + x @ w[size:] + b
        left = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - gold
        g = np.concatenate([np.bincount(column, weights=left[doc] * value, minlength=size), left @ x]) / n + penalty * w
        g = np.append(g, left.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        delta = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - delta[:-1], b - delta[-1]
    words = np.zeros(_FEATURES)
    words[chosen] = w[:size] * weight[chosen]
    return Linear(words, w[size:], float(b), mean)


def train(docs: DataFrame, labels: DataFrame, most: int = 12000, doc_id: str = "doc_id", text: str = "text",
          quality: str = "quality", toxic: str = "toxic", seen: int = 3) -> tuple[Linear, Linear]:
    """Models of "not junk" and of "not toxic" from at most ``most`` labelled documents, those of least hash.

    Rows with a null label count for neither class of it. Features are made where the
    documents lie and counted by Spark; the driver gets only the counts of features and, of the features of
    ``seen`` documents and more, those that tell the classes apart, and no text.
    """
    some = (labels.where(F.col(doc_id).isNotNull())
            .select(F.col(doc_id).alias("id"), F.col(quality).cast("double").alias("q"), F.col(toxic).cast("double").alias("t"))
            .orderBy(F.xxhash64("id"), "id").limit(most))
    given = (docs.select(F.col(doc_id).alias("id"), as_bytes(text).alias("text"))
             .join(F.broadcast(some), "id"))  # ``most`` small rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                doc, feature, stats, _ = features(*buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("q"), part.column("t"),
                     lists(pa.array(feature.astype(np.int32)), np.bincount(doc, minlength=len(stats))),
                     lists(pa.array(stats.ravel()), np.full(len(stats), _STATS))], ["q", "t", "features", "stats"])

    schema = "q double, t double, features array<int>, stats array<float>"
    table = saved(mapped(given.select("text", "q", "t"), run, schema).limit(2 * most), "labelled")
    often = (table.select(F.explode("features").alias("feature")).groupBy("feature").count()
             .where(F.col("count") >= seen).select("feature").toArrow().column("feature").to_numpy())  # of 2**19 at most
    known = np.zeros(_FEATURES, bool)
    known[often] = True
    models = []
    for name, good in (("q", 1.0), ("t", 0.0)):
        labelled = table.where(F.col(name).isNotNull() & ~F.isnan(name))
        gold = (F.col(name) == good).cast("long")
        sizes = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(gold).alias("g")).head()
        share = float(sizes["g"] / sizes["n"]) if sizes["n"] else 1.0
        if share in (0.0, 1.0):
            models.append(constant(share))
            continue
        counts = (labelled.select(gold.alias("gold"), F.explode("features").alias("feature")).groupBy("feature")
                  .agg(F.count(F.lit(1)).alias("total"), F.sum("gold").alias("hits")).toArrow())  # of 2**19 at most
        at = counts.column("feature").to_numpy()
        hits, total = np.zeros(_FEATURES), np.zeros(_FEATURES, np.int64)
        hits[at], total[at] = counts.column("hits").to_numpy(), counts.column("total").to_numpy()
        weight = np.where(known, feature_weights(hits, total, share), 0.0)
        models.append(fit_weighted(*_weighted_rows(labelled, name, good, weight), weight))
    return models[0], models[1]


def _weighted_rows(labelled: DataFrame, name: str, good: float, weight: np.ndarray):
    """(doc, feature, stats, gold) of the labelled rows, with only the features of positive ``weight``.

    The features are sieved where the rows lie; the driver gets the chosen ones only.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(np.packbits(weight > 0))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            held = batch.column("features")
            values, row = held.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy())
            some = kept[values]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name), lists(pa.array(values[some]), np.bincount(row[some], minlength=batch.num_rows)),
                 batch.column("stats")], [name, "features", "stats"])

    table = mapped(labelled.select(name, "features", "stats"), chosen,
                   f"{name} double, features array<int>, stats array<float>").toArrow()
    held = [table.column(c).combine_chunks() for c in ("features", "stats")]
    held = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in held]
    feature, row = held[0].flatten().to_numpy(), held[0].value_lengths().to_numpy()
    gold = (table.column(name).to_numpy() == good).astype(float)
    return np.repeat(np.arange(len(row)), row), feature, held[1].flatten().to_numpy().reshape(-1, _STATS), gold


def evidence(docs: DataFrame, models: tuple[Linear, Linear]) -> DataFrame:
    """``docs`` (with ``text`` last) with ``p``, the classifier's probability that a document is good."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                doc, feature, stats, n_words = features(*buffers(part.column("text")))
                both = [1 / (1 + np.exp(-np.clip(m.logits(doc, feature, stats), -30, 30))) for m in shared.value]
                p = np.clip(both[0] * both[1], 1e-6, 1 - 1e-6)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ints(n_words), pa.array(p)],
                                                 [*part.schema.names[:-1], "n_words", "p"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return mapped(docs, run, f"{schema}, n_words long, p double")


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _strength(shares: DataFrame, least: float = 1.0, most: float = 1e6) -> Column:
    """The beta prior's strength (as a count of documents) that the spread of ``share`` around ``prior`` supports.

    By moments: the spread beyond what ``n`` draws from the prior would show.
    """
    noise = F.sum(F.col("prior") * (1 - F.col("prior")))
    spread = F.sum(F.col("n") * (F.col("share") - F.col("prior")) ** 2)
    extra = (spread - noise) / F.greatest(F.sum("n") - F.count(F.lit(1)), F.lit(1))
    mean = F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior"))) / F.sum("n")
    return F.when(extra > 0, F.greatest(F.least(mean / extra - 1, F.lit(most)), F.lit(least))).otherwise(F.lit(most))


def posteriors(scored: DataFrame) -> DataFrame:
    """``scored`` (host, path, p, …) with ``host_share``, ``path_share`` and ``posterior``.

    Only sums for each path and host are gathered; they are combined before the shuffle and
    joined back from saved tables, so adaptive execution may split a hot host's rows.
    """
    paths = saved(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).head()
    prior = min(max(float(total["s"] / total["n"]) if total["n"] else 0.5, 1e-6), 1 - 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(
        "host", "n", "s", (F.col("s") / F.col("n")).alias("share"), F.lit(prior).alias("prior"))
    hosts = saved(hosts, "hosts")
    k = hosts.agg(_strength(hosts)).head()[0] or 1.0
    shares = hosts.select("host", ((F.col("s") + k * prior) / (F.col("n") + k)).alias("host_share"))
    below = saved(paths.join(shares, "host").withColumns({"share": F.col("s") / F.col("n"), "prior": F.col("host_share")}),
                  "shares")
    k = below.agg(_strength(below)).head()[0] or 1.0
    below = below.select("host", "path", "host_share", ((F.col("s") + k * F.col("prior")) / (F.col("n") + k))
                         .alias("path_share"))
    below = saved(below, "below")
    raised = _logit(F.col("p")) + _logit(F.least(F.greatest("path_share", F.lit(1e-6)), F.lit(1 - 1e-6))) \
        - float(np.log(prior / (1 - prior)))
    return scored.join(below, ["host", "path"]).withColumn("posterior", 1 / (1 + F.exp(-raised)))


def judge(docs: DataFrame, models: tuple[Linear, Linear], host: str = "source", path: Column | None = None,
          doc_id: str = "doc_id", text: str = "text", threshold: float = 0.6) -> DataFrame:
    """One row per document: ``doc_id, content, host, path, n_words, p, host_share, path_share, posterior, kept``.

    ``path`` is a column expression, the whole host where none is given; a null host or
    path counts as an empty one. Null and empty texts have no word features and are judged
    by their statistics and site. Equal rows are judged each; an empty table gives an empty
    result; other columns are not read. ``content`` names a row by id and text.
    """
    place = F.lit("") if path is None else path
    given = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("content"),
                        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                        F.coalesce(place.cast("string"), F.lit("")).alias("path"), as_bytes(text).alias("text"))
    scored = saved(evidence(given, models), "evidence")
    return posteriors(scored).withColumn("kept", F.col("posterior") >= threshold)
