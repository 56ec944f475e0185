"""Test scripts from templates, as string expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.arrays import argument_list, boxed_type, return_type
from tandem.functions.text import bind, words

# Fixed values.
MARKER = {"python": "#TOFILL", "java": "//TOFILL", "cpp": "//TOFILL"}
FILLED, INNER = "f_filled", "f_filled_inner"
PYTHON_HEADER = (
    "import numpy as np \nimport math\nfrom math import *\nimport collections\nfrom collections import *\n"
    "import heapq\nimport itertools\nimport random\nimport sys\n\n"
)
JAVA_PAIR_IMPORT = ("import javafx.util.Pair;", "// import javafx.util.Pair;")


def fill_template(script: Column, function: Column, name: Column, lang: str) -> Column:
    """The script with the renamed function at its marker."""
    renamed = F.replace(function, name, F.lit(FILLED))
    out = F.replace(script, F.lit(MARKER[lang]), renamed)
    if lang == "python":
        return F.concat(F.lit(PYTHON_HEADER), out)
    if lang == "java":
        return F.replace(out, F.lit(JAVA_PAIR_IMPORT[0]), F.lit(JAVA_PAIR_IMPORT[1]))
    return out


def _parameter(kind: Column, i: Column) -> Column:
    def shaped(rest):
        dims = F.octet_length(kind) - F.octet_length(rest)
        return F.concat(F.replace(rest, F.lit("]"), F.lit("")), F.lit(" param"), i, F.lit(" "), F.repeat(F.lit("[ ]"), dims))

    return F.when(~F.contains(kind, F.lit("[")), F.concat(kind, F.lit(" param"), i)).otherwise(
        bind(F.replace(kind, F.lit("["), F.lit("")), shaped))


def _java_argument(gold: Column, mine: Column, i: Column) -> Column:
    p = F.concat(F.lit("param"), i)
    boxed = ((mine == "String") & F.contains(gold, F.lit("char"))) | (mine == boxed_type(gold))
    return (F.when(mine == gold, p).when(boxed, F.concat(mine, F.lit(".valueOf("), p, F.lit(")")))
            .when(gold == "String", F.concat(p, F.lit(".toCharArray()")))
            .otherwise(F.concat(F.lit("("), mine, F.lit(") "), p)))


def _java_calls(s: Column) -> Column:
    return F.transform(s["cells"], lambda c, i: _java_argument(c["g"], c["m"], i))


def _is_vector(c: Column) -> Column:
    return (c["g"] != c["m"]) & F.contains(c["m"], F.lit("vector"))


def _to_string(c: Column) -> Column:
    return (c["m"] == "string") & F.contains(c["g"], F.lit("char"))


def _to_chars(c: Column) -> Column:
    return (c["g"] == "string") & F.contains(c["m"], F.lit("char"))


def _cpp_calls(s: Column) -> Column:
    def call(c, i):
        p = F.concat(F.lit("param"), i)
        return (F.when(c["g"] == c["m"], p).when(_is_vector(c), F.concat(F.lit("vect_"), p))
                .when(_to_string(c), F.concat(F.lit("string_"), p))
                .when(_to_chars(c), F.concat(F.lit("char_arr_"), p))
                .otherwise(F.concat(F.lit("("), c["m"], F.lit(") "), p)))

    return F.transform(s["cells"], call)


def _cpp_setup(s: Column) -> Column:
    """Statements that build vectors, strings and character arrays; null where a vector has no length."""

    def prepare(c, i):
        # the length of an array is the next int argument
        size = F.array_min(F.filter(s["ints"], lambda k: k > i))
        p, kind = F.concat(F.lit("param"), i), F.replace(c["m"], F.lit("&"), F.lit(""))
        return (
            F.when(c["g"] == c["m"], F.lit(""))
            .when(_is_vector(c), F.concat(kind, F.lit(" vect_"), p, F.lit("("), p, F.lit(", "), p,
                                          F.lit(" + param"), size, F.lit(");")))
            .when(_to_string(c), F.concat(kind, F.lit(" string_"), p, F.lit("("), p, F.lit(");")))
            .when(_to_chars(c), F.concat(
                F.lit("char char_arr_"), p, F.lit("["), p, F.lit(".length() + 1];\nstrcopy(char_arr_"), p,
                F.lit(", "), p, F.lit(".c_str());")))
            .otherwise(F.lit("")))

    return F.transform(s["cells"], prepare)


def adapter(script: Column, function: Column, lang: str) -> Column:
    """Source of an ``f_filled`` wrapper that converts the script's argument types to the
    function's and calls ``f_filled_inner``; null when the types already agree or no
    conversion is known."""

    def types(args: Column) -> Column:
        return F.transform(args["type"], lambda t: F.trim(t))

    def prepared(s: Column) -> Column:
        gold, mine = types(s["a"]), types(s["b"])
        n = F.least(F.size(s["a"]), F.size(s["b"]))
        pairs = F.zip_with(gold, mine, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        fields = [gold.alias("gold"), F.slice(pairs, F.lit(1), n).alias("cells"), s["gold_ret"].alias("gold_ret"),
                  s["mine_ret"].alias("mine_ret")]
        if lang != "java":  # array lengths are passed on in C++ only
            at = F.transform(gold, lambda g, i: F.when(g == "int", i))
            fields.append(F.filter(at, lambda i: i.isNotNull()).alias("ints"))
        return F.when(s["a"]["type"] != s["b"]["type"], F.struct(*fields))

    def source(s: Column) -> Column:
        params = F.array_join(F.transform(s["gold"], _parameter), ", ")
        calls = _java_calls(s) if lang == "java" else _cpp_calls(s)
        call = F.concat(F.lit(INNER + "("), F.array_join(calls, ","), F.lit(")"))
        gold_ret = s["gold_ret"]
        call = F.when(gold_ret == s["mine_ret"], call).otherwise(
            F.concat(F.lit("("), gold_ret, F.lit(") "), call))
        head = F.concat(F.lit("static "), gold_ret, F.lit(f" {FILLED}("), params, F.lit(")\n{\n"))
        tail = F.concat(F.lit("return "), call, F.lit(";\n}"))
        if lang == "java":
            return F.when(s.isNotNull(), F.concat(head, tail))

        def with_setup(steps: Column) -> Column:
            lines = F.array_join(F.filter(steps, lambda x: x != ""), "\n")
            setup = F.when(lines == "", F.lit("")).otherwise(F.concat(lines, F.lit("\n")))
            return F.when(~F.exists(steps, lambda x: x.isNull()), F.concat(head, setup, tail))

        return F.when(s.isNotNull(), bind(_cpp_setup(s), with_setup))

    args = F.struct(argument_list(words(script)).alias("a"), argument_list(words(function)).alias("b"),
                    return_type(script).alias("gold_ret"), return_type(function).alias("mine_ret"))
    return bind(bind(args, prepared), source)


def fill_adapted(script: Column, function: Column, name: Column, laid_out: Column, lang: str) -> Column:
    """The script with the inner function and its adapter at the marker. ``laid_out`` is
    the detokenized function."""
    inner = F.replace(laid_out, name, F.lit(INNER))
    body = F.concat(inner, F.lit("\n\n\n"), adapter(script, function, lang))
    return F.replace(script, F.lit(MARKER[lang]), body)
