"""Nesting trees of tokenized code and their subtrees, without a grammar.

A node is a pair of brackets (or of indent marks) with what lies between them; the whole
text is the root. Two subtrees are equal if their tokens have the same kinds in the same
order, so names and literals do not matter. Windows see one document's brackets only.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.structure import _cut, _marked

#: Opening tokens and what closes them (fixed values).
PAIRS = {"(": ")", "[": "]", "{": "}", "INDENT": "DEDENT"}
_MARKS = [*PAIRS, *PAIRS.values(), "NEW_LINE"]


def token_kinds(tokens: Column, keywords: Sequence[str]) -> Column:
    """``id`` for names, ``num`` and ``str`` for literals; keywords and marks stand for themselves."""
    def kind(t: Column) -> Column:
        return (F.when(t.isin([*keywords, *_MARKS]), t).when(F.rlike(t, F.lit(r"^[\p{L}_$][\p{L}\p{N}_$]*$")), "id")
                .when(F.rlike(t, F.lit(r"^[.]?[0-9]")), "num").when(F.rlike(t, F.lit("^[A-Za-z]{0,2}[\"']")), "str").otherwise(t))

    return F.transform(tokens, kind)


def nesting_spans(df: DataFrame, row_id: str, tokens: str) -> DataFrame:
    """``row_id, start, stop, depth`` (positions inclusive) of every node; the root has depth 0.

    A bracket that the next one of its level does not close is no node; what lies in it belongs to the node around it.
    """
    rows = _marked(df, row_id, tokens, _MARKS[:-1])
    tok, pos = F.col("tok"), F.col("pos")
    opens = tok.isin(list(PAIRS))
    order = Window.partitionBy(row_id).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("depth", F.sum(F.when(opens, 1).otherwise(-1)).over(order))
    rows = rows.withColumn("level", F.when(opens, F.col("depth")).otherwise(F.col("depth") + 1))
    near = Window.partitionBy(row_id, "level").orderBy("pos")
    rows = rows.withColumn("end", F.lead(F.struct("pos", "tok")).over(near))
    closing = F.create_map(*[F.lit(x) for pair in PAIRS.items() for x in pair])
    inner = rows.filter(opens & (F.col("end.tok") == F.try_element_at(closing, tok))).select(
        row_id, pos.alias("start"), F.col("end.pos").alias("stop"), F.col("level").cast("int").alias("depth"))
    root = df.filter(F.size(tokens) > 0).select(row_id, F.lit(0).alias("start"), (F.size(tokens) - 1).alias("stop"), F.lit(0).alias("depth"))
    return root.unionByName(inner)


def subtrees(df: DataFrame, row_id: str, tokens: str, keywords: Sequence[str]) -> DataFrame:
    """``row_id, start, stop, depth, digest`` of every subtree; equal digests are equal shapes.

    The work on a document is its length times its depth. Null and empty token lists have no subtrees.
    """
    kinds = df.select(row_id, token_kinds(F.col(tokens), keywords).alias(tokens))
    cut = _cut(kinds, nesting_spans(kinds, row_id, tokens), row_id, tokens)
    return cut.select(row_id, "start", "stop", "depth", F.sha2(F.array_join("span", " "), 256).alias("digest"))
