"""Function spans, data-flow edges and renaming, by windows over one document's tokens.

Only the few tokens that decide a span are exploded; the function text is cut from
the token array afterwards. Every window is bounded by one document.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.text import bind, is_legacy_python, strip_annotations, strip_directives


#: Tokens that stand for the end of a line (fixed values).
LINE_ENDS = ("NEW_LINE", "NEWLINE")


def _marked(df: DataFrame, row_id: str, tokens: str, keep: Sequence[str], neighbours: bool = False,
            skip: Sequence[str] = ()) -> DataFrame:
    """The tokens in ``keep`` with their positions and, on request, the tokens around them.

    Neighbours are those among the tokens that are not in ``skip``; ``solid`` is the number of those, ``at`` the place in them.
    """
    cells = F.transform(F.col(tokens), lambda t, i: F.struct(i.alias("pos"), t.alias("tok")))
    if not neighbours:
        few = F.filter(cells, lambda c: c["tok"].isin(list(keep)))
        return df.select(row_id, F.size(tokens).alias("n"), F.inline_outer(few)).filter(F.col("pos").isNotNull())

    def marks(solid: Column) -> Column:
        few = F.filter(F.transform(solid, lambda c, j: F.struct(c["pos"].alias("pos"), c["tok"].alias("tok"), j.alias("at"))),
                       lambda c: c["tok"].isin(list(keep)))

        def near(c: Column, step: int) -> Column:
            return F.get(solid, c["at"] + step)["tok"]

        return F.transform(few, lambda c: F.struct(
            c["pos"].alias("pos"), c["tok"].alias("tok"), c["at"].alias("at"), F.size(solid).alias("solid"),
            near(c, -1).alias("t1"), near(c, -2).alias("t2"), near(c, -3).alias("t3"), near(c, 1).alias("next")))

    solid = F.filter(cells, lambda c: ~c["tok"].isin(list(skip))) if skip else cells
    return df.select(row_id, F.size(tokens).alias("n"), F.inline_outer(bind(solid, marks))).filter(F.col("pos").isNotNull())


def _cut(df: DataFrame, spans: DataFrame, row_id: str, tokens: str) -> DataFrame:
    """Attach the token run ``start..stop`` (inclusive) of each span."""
    return spans.join(df.select(row_id, tokens), row_id).withColumn(
        "span", F.slice(F.col(tokens), F.col("start") + 1, F.col("stop") - F.col("start") + 1)).drop(tokens)


def brace_spans(df: DataFrame, row_id: str, tokens: str, language: str = "java") -> DataFrame:
    """Functions of tokenized brace code: ``start, stop, kind, function``.

    ``)`` before ``{`` (or before ``throws X {``) opens a body. The function begins
    after the last ``; } {``, or at the comment that ends there, and stops where the
    depth returns. Functions inside a function belong to it. A function with nothing
    in front of it ends the search in its document, and one needs three tokens after
    its closing parenthesis. Line ends between them are passed over. C++: an empty body does not count.
    """
    cpp = language == "cpp"
    rows = _marked(df, row_id, tokens, ["{", "}", ";", "*/", "ENDCOM", "/*", "//"], True, () if cpp else LINE_ENDS)
    tok, pos = F.col("tok"), F.col("pos")
    thrower = "throw" if cpp else "throws"
    plain = F.col("t1") == ")"
    throws = (F.col("t3") == ")") & (F.col("t2") == thrower)
    opens = (tok == "{") & F.coalesce(plain | throws, F.lit(False))
    paren = F.when(F.coalesce(plain, F.lit(False)), F.col("at") - 1).otherwise(F.col("at") - 3)
    if cpp:
        opens = opens & (F.coalesce(F.col("next"), F.lit("}")) != "}")
    else:
        opens = opens & (paren + 3 < F.col("solid"))

    upto = Window.partitionBy(row_id).orderBy("pos")
    so_far = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    delta = F.when(tok == "{", 1).when(tok == "}", -1).otherwise(0)
    limits = ["{", "}", ";"] if cpp else ["{", "}", ";", "*/", "ENDCOM"]
    limit = F.last(F.when(tok.isin(limits), F.struct("pos", "tok")), ignorenulls=True).over(earlier)
    comment = {m: F.last(F.when(tok == m, pos), ignorenulls=True).over(earlier) for m in ("/*", "//")}
    rows = rows.select(
        row_id, "n", "pos", "tok", opens.alias("opens"), F.sum(delta).over(so_far).alias("depth"),
        F.when(limit["tok"] == "*/", comment["/*"]).when(limit["tok"] == "ENDCOM", comment["//"])
        .otherwise(limit["pos"] + 1).alias("start"))
    # an opening brace and its closing brace are neighbours within their level
    braces = rows.filter(tok.isin("{", "}")).withColumn(
        "level", F.when(tok == "{", F.col("depth")).otherwise(F.col("depth") + 1))
    near = Window.partitionBy(row_id, "level").orderBy("pos")
    bodies = braces.withColumn("stop", F.coalesce(F.lead("pos").over(near), F.col("n") - 1)).filter("opens")
    reach = F.max("stop").over(earlier)
    outer = bodies.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("reach") < pos))
    whole = Window.partitionBy(row_id)
    outer = outer.withColumn("lost", F.min(F.when(F.col("start").isNull(), pos)).over(whole)).filter(
        F.col("lost").isNull() | (pos < F.col("lost")))
    spans = outer.select(row_id, "start", "stop", F.col("pos").alias("body"), "depth")
    cut = _cut(df, spans, row_id, tokens)
    head = F.slice("span", F.lit(1), F.col("body") - F.col("start"))
    free = F.array_contains(head, "static")
    text = F.array_join("span", " ")
    if cpp:
        before = F.slice(head, F.lit(1), F.greatest(F.array_position(head, "(").cast("int") - 1, F.lit(0)))
        free = free | (~F.array_contains(before, "::") & (F.col("depth") == 1))
        cut = cut.filter(F.rlike(F.element_at(before, -1), F.lit(r"^[\p{L}_][\p{L}\p{N}_]*$")))
    function = strip_directives(text) if cpp else strip_annotations(text)
    return cut.select(row_id, "start", "stop", F.when(free, "standalone").otherwise("class").alias("kind"),
                      function.alias("function"))


def indent_spans(df: DataFrame, row_id: str, tokens: str) -> DataFrame:
    """Functions of tokenized Python: from ``def`` to the DEDENT that returns to its depth.

    Inner functions belong to the outer one; unfinished, parenthesis-free and
    Python 2 functions are dropped.
    """
    rows = _marked(df, row_id, tokens, ["def", "INDENT", "DEDENT"])
    tok, pos = F.col("tok"), F.col("pos")
    order = Window.partitionBy(row_id).orderBy("pos")
    delta = F.when(tok == "INDENT", 1).when(tok == "DEDENT", -1).otherwise(0)
    rows = rows.withColumn("depth", F.sum(delta).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # walking backwards, the nearest DEDENT seen at the same depth closes the function
    back = Window.partitionBy(row_id, "depth").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    closes = rows.filter(tok != "INDENT").withColumn(
        "stop", F.last(F.when(tok == "DEDENT", pos), ignorenulls=True).over(back)).filter(tok == "def")
    endless = F.lit(2147483647)
    reach = F.max(F.coalesce("stop", endless)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = closes.withColumn("reach", reach).filter(
        (F.col("reach").isNull() | (F.col("reach") < pos)) & F.col("stop").isNotNull())
    cut = _cut(df, outer.select(row_id, F.col("pos").alias("start"), "stop"), row_id, tokens)
    paren = F.array_position("span", "(").cast("int")
    cut = cut.filter(paren > 0).withColumn("function", F.array_join("span", " "))
    kind = F.when(F.get("span", paren) == "self", "class").otherwise("standalone")
    return cut.filter(~is_legacy_python(F.col("function"))).select(
        row_id, "start", "stop", kind.alias("kind"), "function")


# ---- data flow ------------------------------------------------------------
# Edges: keys, pos, var, rel, parents ARRAY<STRING>, parent_pos ARRAY<INT>.

def last_definition(df: DataFrame, keys: Sequence[str], pos: str, name: str, is_def: Column) -> DataFrame:
    """The position where each name was last assigned before; a name never seen defines itself."""
    w = Window.partitionBy(*keys, name).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    seen_first = F.row_number().over(Window.partitionBy(*keys, name).orderBy(pos)) == 1
    marked = df.withColumn("__def", is_def | seen_first)
    return marked.withColumn("def_pos", F.coalesce(
        F.last(F.when(F.col("__def"), F.col(pos)), ignorenulls=True).over(w), F.col(pos))).drop("__def")


def prune_edges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep edges whose position has parents or is a parent."""
    has = F.size("parent_pos") > 0
    linked = F.when(has, F.concat(F.array("pos"), F.col("parent_pos"))).otherwise(F.array().cast("array<int>"))
    connected = edges.select(*keys, F.explode(linked).alias("pos")).distinct()
    return edges.join(connected, [*keys, "pos"], "left_semi")


def merge_edges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One edge per position with the sorted union of parents."""

    def union(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)

    return edges.groupBy(*keys, "pos").agg(F.min("var").alias("var"), F.min("rel").alias("rel"),
                                           union("parents"), union("parent_pos"))


def alpha_rename(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Variables become ``var_i`` by first appearance, the parents of an edge before its variable.

    Several edges may lie at one position; they are taken by relation, variable and parents, and stay apart. Equal edges
    stay as many as they are.
    """
    edge = F.struct("pos", "rel", "var", "parents")
    # an edge's number within its group: a group holds the edges of one function
    numbered = edges.select(*keys, "pos", "rel", "var", "parents",
                            F.row_number().over(Window.partitionBy(*keys).orderBy(edge)).alias("edge"))
    names = F.concat(F.col("parents"), F.array("var"))
    uses = numbered.select(*keys, "edge", "pos", "rel", F.posexplode_outer(names).alias("slot", "name"))
    group, name = Window.partitionBy(*keys), Window.partitionBy(*keys, "name")
    first = F.min(F.struct("edge", "slot")).over(name)
    named = uses.withColumn("first", first)
    fresh = F.concat(F.lit("var_"), F.dense_rank().over(group.orderBy("first")) - 1)
    cells = F.array_sort(F.collect_list(F.struct("slot", "fresh")))
    back = named.withColumn("fresh", fresh).groupBy(*keys, "edge", "pos", "rel").agg(
        F.transform(cells, lambda c: c["fresh"]).alias("names"))
    return back.select(*keys, "pos", "rel", F.element_at("names", -1).alias("var"),
                       F.slice("names", F.lit(1), F.size("names") - 1).alias("parents"))


def sole_function(spans: DataFrame, row_id: str, standalone_only: bool = False) -> DataFrame:
    """``row_id, kind, function`` of the rows that hold exactly one function; of any kind unless told otherwise."""
    one = spans.groupBy(row_id).agg(F.count(F.lit(1)).alias("__n"), F.min("kind").alias("kind"),
                                    F.min("function").alias("function")).filter("__n = 1").drop("__n")
    return one.filter(F.col("kind") == "standalone") if standalone_only else one
