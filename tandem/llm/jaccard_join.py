"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

Shingles are put in one global order, rare ones first as far as a sketch of all counts can
tell. Two sets that are similar enough share at least m of their first tokens if both
prefixes are m - 1 tokens longer than the plain prefix filter needs. Each document chooses
m by the estimated cost of its candidates; the other side's tokens carry the least m at
which they count. A pair is looked for by its rarest shared tokens only and is verified only
if it shares as many prefix tokens as its sizes demand.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm import words as W
from tandem.llm.common import as_bytes, bitmap, buffers, discard, in_bitmap, ints, lists, mapped, pieces, row_key, saved, sieve

_SKETCH = 20  # bits of the sketch's cells
_MOST = 4  # the largest number of prefix matches that is asked for
_FEW = 8  # a pair's rows from tokens of so many sets at most are all made
_MANY = 64  # tokens of so many sets at most are joined without bands
_BAND = 1.09  # the ratio of the bands of sizes
_LAST = 4  # tokens before one whose rows make its own needless


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of ``n`` words of each text, in order.

    A text of fewer words than ``n``, but not none, has the one shingle of all its words.
    """
    w = W.words(*buffers(column), W.SPACED)
    hashes, at = W.grams(w, n)
    doc = w.doc[at]
    few = (w.counts > 0) & (w.counts < n)
    for size in np.unique(w.counts[few]).tolist():
        h, at = W.grams(w, size)
        own = w.counts[w.doc[at]] == size
        hashes = np.concatenate([hashes, h[own] ^ np.uint64(size)])
        doc = np.concatenate([doc, w.doc[at][own]])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def count_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How often shingles occur over all documents, by the low bits of their hash.

    A task sums into one fixed array; arrays are added cell range by cell range, in two
    steps, so no task holds more than a few of them. The result has ``2**20`` numbers.
    """
    ranges = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << _SKETCH, np.int64), 0
        for batch in batches:
            for part in pieces(batch):
                _, tokens = shingle_sets(part.column("text"), n)
                total += np.bincount((tokens & np.uint64((1 << _SKETCH) - 1)).astype(np.int64), minlength=1 << _SKETCH)
                seen += part.num_rows
        if seen:
            group = int(xxhash.xxh3_64_intdigest(total.tobytes()[:1 << 16]) % 64)
            cut = [c.astype(np.uint32).tobytes() for c in np.split(total, ranges)]
            yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([group] * ranges, pa.int32()),
                                              pa.array(cut, pa.binary())], ["part", "slot", "cells"])

    def add(key, table):
        total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in table.column("cells").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "slot": pa.array([0], pa.int32()),
                         "cells": pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())})

    kind = "part int, slot int, cells binary"
    sums = mapped(docs.select("text"), run, kind).groupBy("part", "slot").applyInArrow(add, kind)
    got = {r["part"]: r["cells"] for r in sums.groupBy("part").applyInArrow(add, kind).collect()}
    if not got:
        return np.zeros(1 << _SKETCH, np.float32)
    return np.concatenate([np.frombuffer(got[i], np.uint32) for i in range(ranges)]).astype(np.float32)


def _levels(sketch: np.ndarray) -> np.ndarray:
    """Cells as a few levels of frequency above what other shingles in the cell explain; 0 is rare."""
    usual = float(np.median(sketch))
    over = sketch - (usual + 6 * math.sqrt(usual) + 8)
    return np.where(over > 0, 1 + 2 * np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def _need(size: np.ndarray, t: Fraction) -> np.ndarray:
    """Shared tokens that a set of ``size`` needs at least with any partner."""
    return -(-size * t.numerator // t.denominator)


def _prefix_rows(docs: DataFrame, n: int, t: Fraction, levels: np.ndarray) -> DataFrame:
    """``row, doc_id, size, digest, need, probe, tokens`` per document.

    ``tokens`` are the first ones in the global order, for up to ``_MOST`` matches;
    ``probe`` is the number of matches that the document chose to ask for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    mask = np.uint64((1 << _SKETCH) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for part in pieces(batch):
                doc, tokens = shingle_sets(part.column("text"), n)
                size = np.bincount(doc, minlength=part.num_rows)
                first = np.cumsum(size) - size
                raw = tokens.tobytes()
                digests = [xxhash.xxh3_128_digest(raw[8 * a:8 * (a + s)]) for a, s in zip(first.tolist(), size.tolist())]
                rank = level[(tokens & mask).astype(np.int64)]
                order = np.lexsort((tokens, rank, doc))
                tokens, rank = tokens[order], rank[order]
                need = _need(size, t)
                plain = size - need + 1
                at = np.arange(len(doc)) - first[doc]
                # An entry of a posting list costs one, a candidate that is verified forty.
                cost = np.where(rank > 0, 2.0 ** (rank / 2.0), 1.0)
                sums = np.concatenate([[0], np.cumsum(cost)])
                best, probe = None, np.ones(part.num_rows, np.int64)
                for m in range(1, _MOST + 1):
                    end = first + np.minimum(plain + m - 1, size)
                    scan = sums[end] - sums[first]
                    total = np.where(m <= np.maximum(need, 1), scan * (1 + 40 / m ** 2), np.inf)
                    if best is None:
                        best = total
                    else:
                        probe[total < best], best = m, np.minimum(best, total)
                kept = at < (plain + _MOST - 1)[doc]
                counts = np.bincount(doc[kept], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), ints(size), pa.array(digests, pa.binary()), ints(need),
                     ints(probe), lists(ints(tokens[kept].view(np.int64)), counts)],
                    ["row", "doc_id", "size", "digest", "need", "probe", "tokens"])

    return mapped(docs.select("row", "doc_id", "text"), run,
                  f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, "
                  "digest binary, need long, probe long, tokens array<bigint>")


def _near(t: Fraction) -> str:
    """Sizes ``sa`` and ``sb`` that can be similar at all."""
    return f"{t.denominator} * least(sa, sb) >= {t.numerator} * greatest(sa, sb)"


def _demand(t: Fraction) -> str:
    """Tokens that the prefixes of a similar pair share at least, for ``m`` matches.

    Of the side whose prefix ends first every shared token before that end counts, so the
    overlap is at most their number and what lies behind that prefix. Beyond ``m``, more
    matches are asked for as the sizes ask for more overlap.
    """
    whole = t.numerator + t.denominator
    overlap = f"({t.numerator} * (sa + sb) + {whole - 1}) div {whole}"
    behind = "greatest(sa - least(sa, sa - na + m), sb - least(sb, sb - nb + m))"
    return f"greatest({overlap} - {behind}, least(m, na, nb))"


def _enough(t: Fraction) -> str:
    return f"shared >= {_demand(t)}"


def _early(t: Fraction, place: str, size: str, need: str) -> str:
    """Whether a shared token can be the rarest one of a similar pair: the others it has to share follow in either prefix."""
    return f"{place} <= least({size}, {size} - {need} + m) - {_demand(t)}"


def _banded(postings: DataFrame, t: Fraction, own: str, other: str) -> DataFrame:
    """``postings`` with the key columns ``own`` and ``other``: bands of their set's size and of a partner's.

    A token can be the rarest one that a pair shares only up to a place that depends on both
    sizes (see ``_early``; here with room for rounding, and for the better end of a band), so a posting
    goes to those of the few bands of similar sizes where it may still be. That takes the tokens that a large
    group shares out of the lists of sets which differ before them. Tokens of up to ``_MANY`` sets need no bands.
    """
    r = float(t)
    frequent = postings.where(F.col("df") > _MANY).withColumn(own, F.floor(F.log(F.col("size")) / F.lit(math.log(_BAND))))
    reach = math.floor(-math.log(r) / math.log(_BAND) + 0.01) + 1
    out = postings.where(F.col("df") <= _MANY).withColumns({own: F.lit(-1).cast("long"), other: F.lit(-1).cast("long")})
    for step in range(-reach, reach + 1):
        ends = [f"least(greatest(pow({_BAND}D, {own} + {step + k}) {e}, {r}D * size), size / {r}D)" for k, e in ((0, "- 1"), (1, "+ 1"))]
        fits = [f"place <= size - {r}D / (1 + {r}D) * (size + {x}) + greatest(0, {r}D * ({x} - size)) + 2" for x in ends]
        out = out.unionByName(frequent.where(" or ".join(fits)).withColumn(other, F.col(own) + step))
    return out


def _postings(heads: DataFrame, bits: np.ndarray) -> DataFrame:
    """``row, size, need, probe, token, tier`` of the prefix tokens that may occur in another prefix.

    ``tier`` is the least number of matches for which the token belongs to the prefix.
    """
    shared = heads.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size, need, probe = (batch.column(c).to_numpy() for c in ("row", "size", "need", "probe"))
            held = batch.column("tokens")
            tokens, counts = held.flatten().to_numpy(), held.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(row)), counts)
            place = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
            kept = in_bitmap(shared.value, tokens)
            of, place, tokens = of[kept], place[kept], tokens[kept]
            tier = np.maximum(1, place - (size - need + 1)[of] + 2)
            yield pa.RecordBatch.from_arrays([ints(x) for x in (row[of], size[of], need[of], probe[of], tokens, tier)],
                                             ["row", "size", "need", "probe", "token", "tier"])

    return mapped(heads.select("row", "size", "need", "probe", "tokens"), run,
                  "row long, size long, need long, probe long, token long, tier long")


def _stars(postings: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) of a document and the most typical ones that it shares enough prefix tokens with.

    Only one member of each posting list is a partner, that whose tokens are the most
    frequent, so there are no more rows than postings however long a list is.
    """
    own = postings.where("tier = 1").select("token", "row", "size", "need", "typical")
    top = saved(own.groupBy("token").agg(F.max(F.struct("typical", "row", "size", "need")).alias("one"))
                .select("token", F.col("one.row").alias("a"), F.col("one.size").alias("sa"), F.col("one.need").alias("na")),
                "tops")
    pairs = own.select("token", F.col("row").alias("b"), F.col("size").alias("sb"), F.col("need").alias("nb")).join(top, "token")
    out = saved(pairs.where("a <> b").where(_near(t)).withColumn("m", F.lit(1))
                .groupBy("a", "b", "sa", "sb", "na", "nb", "m").agg(F.count(F.lit(1)).alias("shared"))
                .where(_enough(t)).select("a", "b"), "star")
    discard(top)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets (row, tokens: binary, sorted) are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, cache = [], (None, None)
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"))):
                if cache[0] != a:
                    cache = (a, np.frombuffer(x.as_py(), np.uint64))
                other = np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([cache[1], other])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if t.denominator * shared >= t.numerator * (len(both) - shared):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    left = sets.select(F.col("row").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("tokens").alias("y"))
    return mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``row, root`` for every row in ``links`` (a, b): the least row that links lead to.

    Each round a row takes the least label among itself and its neighbours and then the
    label of that label, which halves long chains; it ends when nothing changes. Labels
    are combined before they are shuffled, and every round's table is written.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("row")).agg(F.min("b").alias("m"))
                   .select("row", F.least("row", "m").alias("root")), "labels")
    held = labels
    while True:
        near = (both.join(labels.withColumnRenamed("row", "b"), "b").groupBy(F.col("a").alias("row"))
                .agg(F.min("root").alias("m")))
        step = saved(labels.join(near, "row").select("row", "root", F.least("root", "m").alias("new")), "step")
        jump = step.select(F.col("row").alias("new"), F.col("new").alias("newer"))
        after = saved(step.join(jump, "new").select("row", F.least("new", "newer").alias("root"),
                                                    (F.least("new", "newer") < F.col("root")).alias("moved")), "labels")
        done = after.where("moved").isEmpty()
        discard(step, held)
        labels, held = after.select("row", "root"), after
        if done:
            discard(both)
            return labels


def similar_groups(docs: DataFrame, n: int = 5, threshold: float = 0.8, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``doc_id, size, component_id, kept, content`` for every row of ``docs``.

    A document's set are its distinct shingles of ``n`` words between white space, A-Z
    lower-cased; fewer words make one shingle. Two documents are linked if their sets'
    intersection is ``threshold`` or more of their union; ``component_id`` is the least
    ``doc_id`` that links lead to, itself included, nulls left out; one row of each component
    is ``kept``, that of the least id; ``content`` names a row by id and text. Null texts and texts
    without words have an empty set and no links; equal rows are linked like others; an
    empty table gives an empty result; other columns are not read.

    Equal sets are collapsed first. Links of the rest are looked for twice: each document
    with the first members of its posting lists, which already joins most groups of copies;
    then all candidates of the prefix join whose components still differ.
    A link inside a component adds nothing to it, so none is missed, and a large group of
    copies costs as many comparisons as it has members, not their square.
    """
    t = Fraction(str(threshold))
    source = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("text"), row_key(doc_id, text).alias("row"))
    levels = _levels(count_sketch(source, n))
    rows = saved(_prefix_rows(source, n, t, levels).withColumn("number", F.monotonically_increasing_id()), "prefixes")
    classes = saved(rows.where("size > 0").groupBy("digest").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("k")),
                    "classes")
    heads = saved(rows.select("row", "size", "need", "probe", "tokens").join(
        classes.select(F.col("head").alias("row")), "row").dropDuplicates(["row"]), "heads")
    again = saved(heads.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
                  .where("df > 1"), "again")
    shared = _postings(heads, bitmap(again, "token", 23)).join(again, "token")
    in_row = Window.partitionBy("row")
    # Places are those by exact frequency in the shortest prefix that holds the token. Tokens of
    # no other prefix come first and were left out.
    before = in_row.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    place = F.lit(0)
    for m in range(1, _MOST + 1):
        held = (F.col("tier") <= m).cast("int")
        inside = (F.least("size", F.col("size") - F.col("need") + m) - F.sum(held).over(in_row)
                  + F.coalesce(F.sum(held).over(before), F.lit(0)))
        place = F.when(F.col("tier") == m, inside).otherwise(place)
    last = in_row.orderBy("df", "token").rowsBetween(-_LAST, -1)
    ahead = F.when(F.col("df") > _FEW, F.collect_list(F.struct("token", "tier")).over(last))
    postings = saved(shared.withColumns({"typical": F.sum("df").over(in_row), "place": place, "ahead": ahead})
                     .withColumn("ahead", F.expr("transform(filter(ahead, s -> s.tier <= tier), s -> s.token)")), "postings")

    discard(again)
    star = _stars(postings, t)
    first = saved(_verified(star, _sets(source, star, n), t), "links")
    labels = components(first)
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("weight"))
    placed = saved(labels.join(sizes, "root"), "placed")
    named = saved(postings.join(placed, "row", "left").select(
        "token", "tier", "df", "place", "ahead", "row", "size", "need", "probe", F.coalesce("root", "row").alias("root"),
        F.coalesce("weight", F.lit(1)).alias("weight")), "named")
    discard(postings, placed)
    order = F.struct("weight", "root")
    spans = saved(named.groupBy("token").agg(F.max(order).alias("high"), F.min(order).alias("low"))
                  .where("low < high").select("token", "high"), "spans")
    mixed = saved(named.join(spans, "token"), "mixed")
    discard(named, spans)
    # The lists are read once for each band.
    left = _banded(mixed.where(order < F.col("high")).where("tier <= probe"), t, "ka", "kb").select(
        "token", "ka", "kb", F.col("row").alias("a"), F.col("size").alias("sa"), F.col("need").alias("na"),
        F.col("probe").alias("m"), F.col("place").alias("pa"), F.col("ahead").alias("la"), F.col("root").alias("ra"), F.col("weight").alias("wa"))
    right = _banded(mixed, t, "kb", "ka").select(
        "token", "ka", "kb", F.col("row").alias("b"), F.col("size").alias("sb"), F.col("need").alias("nb"),
        F.col("tier").alias("tb"), F.col("place").alias("pb"), F.col("ahead").alias("lb"), F.col("root").alias("rb"),
        F.col("weight").alias("wb"))
    found = (left.join(right, ["token", "ka", "kb"]).where("tb <= m").where("wa < wb or (wa = wb and ra < rb)")
             .where(_near(t)).where(_early(t, "pa", "sa", "na")).where(_early(t, "pb", "sb", "nb"))
             # A pair that shares a token shortly before this one has its row from there.
             .where("la is null or not arrays_overlap(la, lb)").select("a", "b", "m"))
    pairs = saved(found.distinct(), "pairs")
    discard(mixed)
    found = saved(pairs.join(first.select("a", "b"), ["a", "b"], "left_anti"), "found")
    lists = heads.select("row", "size", "need", "tokens")
    both = found.join(lists.toDF("a", "sa", "na", "ta"), "a").join(lists.toDF("b", "sb", "nb", "tb"), "b")
    # A document that chose to ask for more matches has so many more tokens in its prefix.
    ahead = "size(array_intersect(slice(ta, 1, cast(least(sa, sa - na + m) as int)), slice(tb, 1, cast(least(sb, sb - nb + m) as int))))"
    candidates = saved(both.withColumn("shared", F.expr(ahead)).where(_enough(t)).select("a", "b"), "candidates")
    second = saved(_verified(candidates, _sets(source, candidates, n), t), "links")
    discard(pairs, found, star, candidates)
    labels = components(first.union(second))
    # A text without shingles is linked with nothing: its root is a number of its own.
    inside = saved(rows.join(classes.select("digest", "head"), "digest", "left")
                   .select("number", "row", "doc_id", "size", "head"), "inside")
    inside = saved(inside.join(labels.withColumnRenamed("row", "head"), "head", "left").select(
        "number", "row", "doc_id", "size", F.coalesce("root", "head").alias("root"),
        F.when(F.col("head").isNull(), F.col("number")).alias("own")), "rooted")
    first_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")
    least = saved(inside.groupBy("root").agg(F.min(first_id).alias("one"), F.count(F.lit(1)).alias("k"))
                  .where("k > 1").drop("k"), "least")
    alone = F.col("one").isNull() | F.col("own").isNotNull()
    return inside.join(least, "root", "left").select(
        "doc_id", "size", F.when(alone, F.col("doc_id")).otherwise(F.col("one.doc_id")).alias("component_id"),
        (alone | (F.col("one.number") == F.col("number"))).alias("kept"), F.col("row").alias("content"))


def _sets(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """``row, tokens``: the whole sets of the documents in ``pairs``, as sorted 64-bit numbers.

    A bitmap of their rows is tested on every document; the join that follows is exact.
    """
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b"))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(sieve(batch, "row", shared.value)):
                doc, tokens = shingle_sets(part.column("text"), n)
                ends = np.cumsum(np.bincount(doc, minlength=part.num_rows)) * 8
                raw = tokens.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array([raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())],
                                                  pa.binary())], ["row", "tokens"])

    return mapped(docs.select("row", "text"), run, "row long, tokens binary")
