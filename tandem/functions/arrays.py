"""Token-array expressions: n-grams, lookups, padding, noising."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.hashing import uniform
from tandem.functions.text import bind, empty_tokens, words


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, each joined by a blank (tokens hold none)."""
    size = F.size(tokens)
    if n == 1:
        return tokens
    return F.when(
        size >= n,
        F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(empty_tokens())


def pad_ends(tokens: Column, n: int, left: str | None = None, right: str | None = None) -> Column:
    """``n - 1`` pad symbols on either side, where a symbol is given."""
    parts = [F.array_repeat(F.lit(left), n - 1)] if left is not None else []
    parts.append(tokens)
    if right is not None:
        parts.append(F.array_repeat(F.lit(right), n - 1))
    return F.concat(*parts)


def before_marker(tokens: Column, marker: str) -> Column:
    """Tokens left of the first ``marker``; null when it is missing."""
    at = F.array_position(tokens, marker).cast("int")
    return F.when(at > 0, F.slice(tokens, F.lit(1), at - 1))


def after_marker(tokens: Column, marker: str) -> Column:
    at = F.array_position(tokens, marker).cast("int")
    return F.when(at > 0, F.get(tokens, at))


def is_static(tokens: Column) -> Column:
    return F.array_contains(before_marker(tokens, "{"), "static")


def is_free_function(tokens: Column) -> Column:
    return after_marker(tokens, "(") != "self"


def name_before_paren(tokens: Column) -> Column:
    """The token before the first ``(``; a leading ``(`` wraps round to the last token."""
    at = F.array_position(tokens, "(").cast("int")
    return F.when(at > 1, F.get(tokens, at - 2)).when(at == 1, F.element_at(tokens, -1))


def name_after_def(tokens: Column) -> Column:
    at = F.array_position(tokens, "def").cast("int")
    return F.when(at > 0, F.get(tokens, at))


def first_parens(tokens: Column) -> Column:
    """Tokens inside the first balanced parentheses; without a close, all but the last."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end"))

    def step(s, t):
        depth = s["depth"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
        i = s["i"] + 1
        return F.struct(
            depth.alias("depth"), i.alias("i"),
            F.when((s["end"] == 0) & (depth == 0), i).otherwise(s["end"]).alias("end"))

    def inside(tail):
        # with a single "(" the first ")" closes it; only nesting needs the depth walk
        close = F.array_position(tail, ")").cast("int")
        simple = (close > 0) & ~F.array_contains(F.slice(tail, F.lit(2), F.greatest(close - 1, F.lit(0))), "(")
        end = F.when(simple, close).otherwise(
            F.aggregate(tail, zero, step, lambda s: F.when(s["end"] > 0, s["end"]).otherwise(s["i"])))
        return F.slice(tail, F.lit(2), F.greatest(end - 2, F.lit(0)))

    def opened(t):
        return bind(F.array_position(t, "(").cast("int"),
                    lambda at: F.when(at > 0, bind(F.slice(t, at, F.size(t)), inside)))

    return bind(tokens, opened)


def single_blanks(c: Column) -> Column:
    """Runs of blanks become one blank; the pattern is needed only for runs of over two."""
    two = F.lit("  ")
    return F.when(F.contains(c, two), bind(F.replace(c, two, F.lit(" ")), lambda x: F.when(
        F.contains(x, two), F.regexp_replace(x, " +", " ")).otherwise(x))).otherwise(c)


def argument_list(tokens: Column) -> Column:
    """Arguments as ``(type, name)``; no arguments give one ``(None, None)``."""

    mark = F.lit("[ ]")

    def one(arg):
        """Name: the last word. Type: all before it, then the array marks."""

        def split_name(bare, m):
            return bind(single_blanks(F.trim(bare)), lambda x: bind(F.substring_index(x, " ", -1), lambda name: F.struct(
                F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(name)), m).alias("type"), name.alias("name"))))

        def marked(rest):
            more = F.octet_length(arg) - F.octet_length(rest) - 3
            return F.when(more == 0, split_name(rest, mark)).otherwise(bind(
                F.concat(mark, F.repeat(F.lit(" [ ]"), (more / 3).cast("int"))),
                lambda m: split_name(F.replace(arg, m, F.lit("")), m)))

        return F.when(F.contains(arg, mark), bind(F.replace(arg, mark, F.lit("")), marked)).otherwise(
            split_name(arg, F.lit("")))

    none = F.array(F.struct(F.lit("None").alias("type"), F.lit("None").alias("name")))
    return bind(F.array_join(first_parens(tokens), " "),
                lambda inner: F.when(inner == "", none).otherwise(F.transform(F.split(inner, ","), one)))


def return_type(code: Column) -> Column:
    return F.try_element_at(words(F.substring_index(code, "(", 1)), F.lit(-2))


# Object names of the primitive Java types.
BOXED = {"short": "Short", "int": "Integer", "long": "Long", "float": "Float", "double": "Double",
         "boolean": "Boolean", "char": "Character"}


def boxed_type(t: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in BOXED.items() for x in kv])
    return F.coalesce(F.try_element_at(table, t), t)


# ---- special tokens and padding -------------------------------------------

def truncate_with_end(tokens: Column, limit: int, end: Column) -> Column:
    """Cut to ``limit`` entries, the last of which becomes ``end``."""
    return F.when(F.size(tokens) > limit, F.concat(F.slice(tokens, 1, limit - 1), F.array(end))).otherwise(tokens)


def strip_end(tokens: Column, end: Column) -> Column:
    """Drop one trailing ``end`` token."""
    return F.when(F.try_element_at(tokens, F.lit(-1)) == end,
                  F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens)


def frame(tokens: Column, limit: int, end: str, prepend: str | None = None, append: str | None = None) -> Column:
    """Strip the end token, cut to ``limit - 1``, put the end token back, add tags."""
    body = F.concat(F.slice(strip_end(tokens, F.lit(end)), 1, limit - 1), F.array(F.lit(end)))
    parts = ([F.array(F.lit(prepend))] if prepend else []) + [body] + ([F.array(F.lit(append))] if append else [])
    return F.concat(*parts) if len(parts) > 1 else body


def pad(tokens: Column, width: Column, symbol: Column, left: bool) -> Column:
    filler = F.array_repeat(symbol, F.greatest(width - F.size(tokens), F.lit(0)))
    return F.concat(filler, tokens) if left else F.concat(tokens, filler)


def shift_right(tokens: Column) -> Column:
    """Move the last token to the front (decoder input)."""
    return F.when(F.size(tokens) > 0, F.concat(F.array(F.element_at(tokens, -1)),
                                               F.slice(tokens, F.lit(1), F.size(tokens) - 1))).otherwise(tokens)


def lang_tag(lang: Column) -> Column:
    return F.concat(F.lit("__"), lang, F.lit("__"))


def first_lang_tag(tokens: Column, langs: list[str]) -> Column:
    tags = F.array(*[F.lit(f"__{x}__") for x in langs])
    return F.coalesce(F.get(F.filter(tokens, lambda t: F.array_contains(tags, t)), F.lit(0)), F.lit(""))


# ---- noising --------------------------------------------------------------
# The first token is a start mark and never moves or disappears.

def local_shuffle(tokens: Column, reach: float, seed: int, row_id: Column) -> Column:
    """Sort by position plus a uniform draw below ``reach``."""
    scored = F.transform(tokens, lambda t, i: F.struct(
        F.when(i == 0, F.lit(-1.0)).otherwise(i + uniform(seed, row_id, i) * reach).alias("score"),
        i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(scored), lambda s: s["t"])


def drop_tokens(tokens: Column, p: float, seed: int, row_id: Column) -> Column:
    """Drop each token with probability ``p``; one drawn token stays if all would go."""
    kept = F.filter(tokens, lambda t, i: (i == 0) | (uniform(seed, row_id, i) >= p))
    n = F.size(tokens)
    spare = F.get(tokens, (F.lit(1) + F.floor(uniform(seed + 1, row_id) * (n - 1))).cast("int"))
    return F.when((F.size(kept) == 1) & (n > 1), F.concat(kept, F.array(spare))).otherwise(kept)


def blank_tokens(tokens: Column, p: float, mask: str, seed: int, row_id: Column) -> Column:
    return F.transform(tokens, lambda t, i: F.when(
        (i == 0) | (uniform(seed, row_id, i) >= p), t).otherwise(F.lit(mask)))
