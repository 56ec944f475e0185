"""Phrase collocations by relational mining: sorted occurrence relations that grow word by word.

Relation k holds, block of texts by block and sorted by piece and position, where frequent
phrases of k words start. A merge join of the relation with itself at the next position gives
the occurrences of k + 1 words; they are counted per block, the counts of all blocks are added,
and the groups that are frequent over all documents are semi-joined back to each block before
the next length. A part of a frequent phrase is at least as frequent, so nothing is lost.
Occurrences never leave their block: what is shuffled are distinct groups of blocks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import as_bytes, buffers, discard, ints, mapped, pieces, saved

#: Bytes of text in a block; a longer text is a block by itself.
BLOCK = 8 << 20
#: Bits of a group's number in its block.
_SHIFT = 26
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK, _END = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts that lie end to end, the text of each, and whether it begins a piece."""
    end = _END[data]
    inside = ~(end | _BLANK[data])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    mark = inside.copy()
    mark[1:] &= ~inside[:-1] | edge[1:-1]
    start = np.flatnonzero(mark).astype(np.int32 if len(data) < 1 << 31 else np.int64)
    mark[:] = inside
    mark[:-1] &= ~inside[1:] | edge[1:-1]
    size = np.flatnonzero(mark).astype(start.dtype) + 1 - start
    del mark, edge
    doc = (np.searchsorted(offsets, start, "right") - 1).astype(np.int32)
    ends = np.cumsum(end, dtype=start.dtype)[start] if len(start) else start
    fresh = np.ones(len(start), bool)
    fresh[1:] = (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1])
    del end, ends
    bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    held = pa.py_buffer(_LOWER[data[inside]].tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), held]), doc, fresh


def _packed(values: np.ndarray) -> bytes:
    """Compressed, with the number of bytes in front: the relation is shuffled once for each length."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    raw = value.as_buffer()
    size = int.from_bytes(raw[:8].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=size, codec="zstd"), kind)


def occurrences(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """The relation of single words: a row for each block of texts.

    ``ids`` has for each occurrence, piece by piece, the number of its group in the block, and
    -1 between pieces; ``langs``, ``names`` and ``n`` are the groups: language, word, count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 16
        for batch in batches:
            for part in pieces(batch, "text", BLOCK):
                names, doc, fresh = cut(*buffers(part.column("text")))
                if not len(names):
                    continue
                coded, of = names.dictionary_encode(), part.column("lang").dictionary_encode()
                width = len(of.dictionary)
                pair = coded.indices.to_numpy().astype(np.int64) * width + of.indices.to_numpy().astype(np.int64)[doc]
                group, code, count = np.unique(pair, return_inverse=True, return_counts=True)
                ids = np.full(len(code) + int(fresh.sum()), -1, np.int32)
                ids[np.arange(len(code)) + np.cumsum(fresh)] = code
                one = np.array([0, len(group)], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ints(np.array([number])), pa.array([_packed(ids)], pa.binary()),
                     pa.ListArray.from_arrays(one, of.dictionary.take(pa.array(group % width))),
                     pa.ListArray.from_arrays(one, coded.dictionary.take(pa.array(group // width)).cast(pa.binary())),
                     pa.ListArray.from_arrays(one, ints(count))], ["block", "ids", "langs", "names", "n"])
                number += 1

    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), as_bytes(text).alias("text"))
    return saved(mapped(given, run, "block long, ids binary, langs array<string>, names array<binary>, n array<long>"),
                 "occurrences")


def _places(ids: np.ndarray, at: pa.Scalar, size: int) -> np.ndarray:
    """Where the relation's phrases start; those of one word are the ids themselves and are not written twice."""
    return np.flatnonzero(ids >= 0) if size == 1 else _array(at, np.int32)


def _longer(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where phrases of ``size + 1`` words start whose first and last ``size`` words are in the relation ``at``.

    With them the number of each one's group in the block, and a member of each group.
    """
    held = np.zeros(len(ids) + 1, bool)
    held[at] = True
    start = at[held[at + 1]].astype(np.int64)
    width, key = int(ids.max(initial=0)) + 1, np.zeros(len(start), np.int64)
    first = key
    for j in range(size + 1):
        _, first, key = np.unique(key * width + ids[start + j], return_index=True, return_inverse=True)
    return start, key, start[first]


def _words(size: int) -> list[str]:
    return [f"w{i}" for i in range(1, size + 1)]


def _groups(relation: DataFrame, size: int) -> DataFrame:
    """``at, w1.., n``: the groups of ``size + 1`` words of each block; ``at`` is the block and the group's number in it."""
    names = ["at", *_words(size + 1), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b, c in zip(*(batch.column(x) for x in ("block", "ids", "at", "vocab"))):
                ids, vocab = _array(a, np.int32), _array(c, np.int64)
                _, key, member = _longer(ids, _places(ids, b, size), size)
                columns = [(block.as_py() << _SHIFT) + np.arange(len(member)), *(vocab[ids[member + j]] for j in range(size + 1)), np.bincount(key, minlength=len(member))]
                yield pa.RecordBatch.from_arrays([ints(x) for x in columns], names)

    return mapped(relation, run, ", ".join(f"{n} long" for n in names))


_RELATION = "block long, ids binary, at binary, vocab binary"


def _row(block: pa.Scalar, ids: np.ndarray, at: np.ndarray, vocab: np.ndarray) -> pa.Table:
    return pa.table({"block": pa.array([block.as_py()], pa.int64()), **{
        k: pa.array([_packed(v)], pa.binary()) for k, v in (("ids", ids), ("at", at), ("vocab", vocab))}})


def _semi_joined(relation: DataFrame, frequent: DataFrame, size: int) -> DataFrame:
    """The next relation: of each block's occurrences of ``size`` words those in one of its ``frequent`` groups.

    For one word, ``frequent`` also has the number that the word has over all documents.
    """
    def words(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _row(pa.scalar(0), *(np.empty(0, k) for k in (np.int32, np.int32, np.int64))).slice(0, 0)
        ids = _array(left.column("ids")[0], np.int32)
        kept, vocab = right.column("g").to_numpy(), right.column("id").to_numpy()
        new = np.full(max(int(ids.max(initial=0)), int(kept.max(initial=0))) + 2, -1, np.int32)
        new[kept] = np.arange(len(kept))
        ids = new[ids]  # -1, between pieces, is the last place
        return _row(left.column("block")[0], ids, np.empty(0, np.int32), vocab)

    def phrases(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["block", "ids", "at", "vocab"])
        ids, vocab = _array(left.column("ids")[0], np.int32), _array(left.column("vocab")[0], np.int64)
        start, key, member = _longer(ids, _places(ids, left.column("at")[0], size - 1), size - 1)
        kept = np.zeros(len(member), bool)
        kept[right.column("g").to_numpy()] = True
        return _row(left.column("block")[0], ids, start[kept[key]].astype(np.int32), vocab)

    both = relation.groupBy("block").cogroup(frequent.groupBy("block"))
    return saved(both.applyInArrow(words if size == 1 else phrases, _RELATION), "occurrences")


def frequent_phrases(docs: DataFrame, longest: int, least: int, lang: str, text: str) -> tuple[DataFrame, list[DataFrame]]:
    """``lang, n`` (all words), and for each length the frequent groups with their count ``f``.

    Groups of one word are ``id, lang, word, f``; longer ones ``w1, w2, .., f`` by those ids.
    """
    first = occurrences(docs, lang, text)
    groups = first.select("block", F.posexplode(F.arrays_zip("langs", "names", "n")).alias("g", "one")).select(
        (F.shiftleft("block", _SHIFT) + F.col("g")).alias("at"), F.col("one.langs").alias("lang"),
        F.col("one.names").alias("word"), F.col("one.n").alias("n"))
    totals = saved(groups.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    keys, found, relation = ["lang", "word"], [], first
    for size in range(1, longest + 1):
        if size == longest > 1:  # nothing is made from these
            found.append(saved(groups.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least), "groups"))
            break
        # A block has a group once, so no group has more rows here than there are blocks. The first
        # block's number of a group is its number over all documents, and only that row keeps the words.
        whole = Window.partitionBy(*keys)
        held = groups.withColumns({"f": F.sum("n").over(whole), "id": F.min("at").over(whole)}).where(F.col("f") >= least)
        own = F.col("at") == F.col("id")
        held = saved(held.select("at", "id", "f", *(F.when(own, F.col(k)).alias(k) for k in keys)), "held")
        found.append(saved(held.where(own).select("id", *keys, "f"), "groups"))
        if size < longest:
            back = held.select(F.shiftright("at", _SHIFT).alias("block"), F.col("at").bitwiseAND((1 << _SHIFT) - 1).alias("g"),
                               *(["id"] if size == 1 else []))
            longer = _semi_joined(relation.select(*[c for c in relation.columns if c in ("block", "ids", "at", "vocab")]),
                                  back, size)
            discard(held, relation)
            relation, groups, keys = longer, _groups(longer, size), _words(size + 1)
    return totals, found


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000,
                 lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and those into words
    at blanks and tabs. A phrase of 2 to ``longest`` words is a candidate if it occurs ``a >= least``
    times in pieces of its language, overlaps included. Its score is the least of
    ``floor(1000000 a a / (l r))`` over its cuts into a first part that occurs ``l`` and a rest that occurs
    ``r`` times, the earliest cut of equal ones, in whole numbers of up to 38 digits. A candidate
    inside a longer one that occurs at least ``cover`` % as often is dropped. ``n`` counts the words
    of the language. Ranks go by score, ``a`` (both falling) and phrase.

    Null texts have no words, null languages are ``und``, repeated rows count each, ties are settled
    by the phrase, an empty table gives an empty result and other columns are not read.
    """
    totals, found = frequent_phrases(docs, longest, least, lang, text)
    words, kept = found[0], []
    for size in range(2, longest + 1):
        own, rows = _words(size), found[size - 1]
        around = [(longer, j) for longer in range(size + 1, longest + 1) for j in range(longer - size + 1)]
        if around:
            inside = [found[k - 1].select(*(F.col(f"w{i + j}").alias(f"w{i}") for i in range(1, size + 1)),
                                          F.col("f").alias("around")) for k, j in around]
            for more in inside[1:]:
                inside[0] = inside[0].unionByName(more)
            most = inside[0].groupBy(*own).agg(F.max("around").alias("around"))
            rows = rows.join(most, own, "left").where(
                f"around is null or cast(100 as decimal(4, 0)) * around < cast({cover} as decimal(4, 0)) * f").drop("around")
        for j in range(1, size + 1):
            word = words.select(F.col("id").alias(f"w{j}"), F.col("word").alias(f"t{j}"), F.col("f").alias(f"f{j}_{j}"),
                                *(["lang"] if j == 1 else []))
            rows = rows.join(word, f"w{j}")
        for a, b in [(1, k) for k in range(2, size)] + [(k, size) for k in range(2, size)]:
            part = found[b - a].select(*(F.col(f"w{i}").alias(f"w{i + a - 1}") for i in range(1, b - a + 2)),
                                       F.col("f").alias(f"f{a}_{b}"))
            rows = rows.join(part, [f"w{i}" for i in range(a, b + 1)])
        cuts = [f"struct(cast(1000000 as decimal(7, 0)) * cast(f as decimal(15, 0)) * cast(f as decimal(15, 0)) div "
                f"(cast(f1_{k} as decimal(15, 0)) * cast(f{k + 1}_{size} as decimal(15, 0))) as score, {k} as k, "
                f"f1_{k} as l, f{k + 1}_{size} as r)" for k in range(1, size)]
        phrase = F.concat_ws(" ", *(F.col(f"t{j}").cast("string") for j in range(1, size + 1)))
        kept.append(rows.select("lang", phrase.alias("phrase"), F.col("f").alias("a"),
                                F.expr(f"array_min(array({', '.join(cuts)}))").alias("cut")))
    for more in kept[1:]:
        kept[0] = kept[0].unionByName(more)
    rows = kept[0].select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
