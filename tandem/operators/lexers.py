"""Code tokens, by one lexer pattern for brace languages and one for Python."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.text import C_FAMILY_SYMBOLS, PYTHON_SYMBOLS, bind, literal_tokens
from tandem.scale import placed

# Operators of more than one character, longest first.
OPERATORS = [">>>=", "<<=", ">>=", ">>>", "...", "->*", "::", "->", "++", "--", "&&", "||", "==", "!=", "<=", ">=",
             "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>"]


def _escape(op: str) -> str:
    return "".join("\\" + c if c in ".+*|^$?()[]{}\\" else c for c in op)


_NUMBER = r"0[xX][0-9a-fA-F_]+[lLuU]*|[0-9][0-9_]*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?[fFdDlLuU]*"


def lexer(possessive: bool = True) -> str:
    """Lexer alternation; the possessive form keeps the Java matcher's stack flat."""
    p = "+" if possessive else ""
    text2 = rf'"[^\\"]*{p}(?:\\.[^\\"]*{p})*{p}"'
    text1 = rf"'[^\\']*{p}(?:\\.[^\\']*{p})*{p}'"
    ops = "|".join(_escape(o) for o in OPERATORS)
    return rf"(?s)//[^\n]*|/\*.*?\*/|{text2}|{text1}|[\p{{L}}_$][\p{{L}}\p{{N}}_$]*|{_NUMBER}|{ops}|\S"


def _is_comment(t: Column) -> Column:
    return (F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("/*"))) & (F.length(t) > 1)


def _is_literal(t: Column) -> Column:
    return (F.startswith(t, F.lit('"')) | F.startswith(t, F.lit("'"))) & (F.length(t) > 1)


def c_tokens(code: Column, keep_comments: bool = False) -> Column:
    """Tokens of a brace language; comments dropped unless kept, literals in blank-separated form.

    Balanced source lexes as a grammar would; broken source may differ from one.
    """
    raw = F.regexp_extract_all(F.replace(code, F.lit("\r"), F.lit("")), F.lit(lexer()), F.lit(0))
    if not keep_comments:
        raw = F.filter(raw, lambda t: ~_is_comment(t))

    def clean(t: Column) -> Column:
        out = F.when(_is_literal(t), literal_tokens(t, C_FAMILY_SYMBOLS))
        if keep_comments:
            out = out.when(_is_comment(t), literal_tokens(t, C_FAMILY_SYMBOLS, comment=True))
        return out.otherwise(t)

    return F.filter(F.transform(raw, clean), lambda t: t != "")


# ---- Python ---------------------------------------------------------------

# Operators of more than one character, longest first, and the single ones.
PYTHON_OPERATORS = ["**=", "//=", ">>=", "<<=", "...", "**", "//", ">>", "<<", "<=", ">=", "==", "!=", "->", "+=", "-=",
                    "*=", "/=", "%=", "&=", "|=", "^=", "@=", ":="]
PYTHON_MARKS = "()[]{},:;.+-*/%&|^~<>=@"


def _python_lexer() -> str:
    """Strings, comments, joined lines, line ends with the next line's indentation, blanks, numbers, names, marks.

    Quantifiers are possessive, so that long strings do not deepen the matcher's stack.
    """
    def long_string(q: str) -> str:
        return rf"{q * 3}[^{q}\\]*+(?:(?:\\.|{q}(?!{q * 2}))[^{q}\\]*+)*+{q * 3}"

    def string(q: str) -> str:
        return rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}"

    strings = "|".join([long_string('"'), long_string("'"), string('"'), string("'")])
    number = r"0[xXoObB][0-9a-fA-F_]++|(?:[0-9][0-9_]*+\.?[0-9_]*+|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9_]++)?[jJ]?"
    ops = "|".join(_escape(o) for o in PYTHON_OPERATORS)
    return (rf"(?s)[rRbBuUfF]{{0,2}}+(?:{strings})|#[^\n]*+|\\\n|\n[ \t\f]*+|[ \t\f]++|{number}"
            rf"|[\p{{L}}_][\p{{L}}\p{{N}}_]*+|{ops}|.")


#: Lines that are put together before they are appended to the rest of a document.
_BLOCK = 256


def _marked(lines: Column) -> Column:
    """Lines with the INDENT and DEDENT marks in front of them, and whether all of them close a level that was opened.

    A level that holds a docstring only gets neither mark: its INDENT waits for the next line. Lines are
    taken in blocks, and only a block's own tokens are appended to line by line.
    """
    def repeat(mark: str, times: Column) -> Column:
        return F.array_repeat(F.lit(mark), times.cast("int"))

    def step(acc: Column, line: Column) -> Column:
        width, code = line["width"], line["code"]
        kept = F.filter(acc["levels"], lambda x: x <= width)
        pops = F.size(acc["levels"]) - F.size(kept)
        deeper = F.coalesce(F.get(kept, F.size(kept) - 1), F.lit(-1)) < width
        waits = acc["waits"]
        before = F.when(waits & (pops > 0), repeat("DEDENT", pops - 1)).when(
            waits, repeat("INDENT", F.lit(1))).otherwise(repeat("DEDENT", pops))
        now = deeper & ~line["doc"]
        marks = F.when(now, F.concat(before, repeat("INDENT", F.lit(1)))).otherwise(before)
        moved = F.struct(
            F.when(deeper, F.concat(kept, F.array(width))).otherwise(kept).alias("levels"),
            (deeper & line["doc"]).alias("waits"), (acc["good"] & ~((pops > 0) & deeper)).alias("good"),
            F.concat(acc["out"], F.array(F.concat(marks, line["tokens"]))).alias("out"))
        aside = F.struct(acc["levels"].alias("levels"), waits.alias("waits"), acc["good"].alias("good"),
                         F.concat(acc["out"], F.array(line["tokens"])).alias("out"))
        return F.when(code, moved).otherwise(aside)

    def block(acc: Column, some: Column) -> Column:
        start = F.struct(acc["levels"].alias("levels"), acc["waits"].alias("waits"), acc["good"].alias("good"),
                         F.array().cast("array<array<string>>").alias("out"))
        return bind(F.aggregate(some, start, step), lambda x: F.struct(
            x["levels"].alias("levels"), x["waits"].alias("waits"), x["good"].alias("good"),
            F.concat(acc["blocks"], F.array(F.flatten(x["out"]))).alias("blocks")))

    firsts = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.array(F.lit(0)).alias("levels"), F.lit(False).alias("waits"), F.lit(True).alias("good"),
                     F.array().cast("array<array<string>>").alias("blocks"))
    return F.aggregate(F.transform(firsts, lambda i: F.slice(lines, i, F.lit(_BLOCK))), start, block, lambda acc: F.struct(
        acc["good"].alias("good"), F.flatten(F.concat(acc["blocks"], F.array(repeat(
            "DEDENT", F.size(acc["levels"]) - 1 - acc["waits"].cast("int"))))).alias("tokens")))


def python_tokens(df: DataFrame, row_id: str, code: str, keep_comments: bool = False) -> DataFrame:
    """``row_id, status, tokens, stripped``; status ``err`` and nulls where brackets, strings or levels do not close.

    Line ends inside brackets count for nothing. A string that is a whole line is dropped
    with its line end; other literals come in blank-separated form, comments too if kept.
    ``stripped`` is the source without comments and without strings that begin a line,
    columns kept, blank lines dropped. ``row_id`` must be unique. A document is placed by
    its id once; its tokens are rows of that partition only.
    """
    source = F.concat(F.lit("\n"), F.regexp_replace(F.col(code), r"\r|\\r", ""), F.lit("\n"))
    raw = F.regexp_extract_all(source, F.lit(_python_lexer()), F.lit(0))
    rows = placed(df.select(F.col(row_id), F.col(code)), [row_id]).select(row_id, F.posexplode_outer(raw).alias("pos", "t"))
    first, last = F.substring("t", 1, 1), F.substring("t", -1, 1)
    kind = (F.when(first == "\n", "line").when(first == "#", "comment").when(F.rlike("t", F.lit(r"^[ \t\f]|^\\\n")), "blank")
            .when(last.isin('"', "'") & (F.length("t") > 1), "string").when(F.col("t").isin("(", "[", "{"), "open")
            .when(F.col("t").isin(")", "]", "}"), "close")
            .when((F.length("t") == 1) & ~F.rlike("t", F.lit(r"[\p{L}\p{N}_]")) & ~F.instr(F.lit(PYTHON_MARKS), F.col("t")).cast("boolean"),
                  "bad").otherwise("plain"))
    doc = Window.partitionBy(row_id).orderBy("pos")
    so_far = doc.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kind", kind).withColumn("depth", F.sum(
        F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)).over(so_far))
    ends = (F.col("kind") == "line") & (F.col("depth") == 0)
    rows = rows.withColumn("line", F.sum(ends.cast("int")).over(so_far)).withColumn("before", F.lag("t").over(doc))
    text = (F.when(F.col("kind") == "string", literal_tokens(F.col("t"), PYTHON_SYMBOLS))
            .when(F.col("kind") == "comment", literal_tokens(F.col("t"), PYTHON_SYMBOLS, comment=True)).otherwise(F.col("t")))
    is_code = ~F.col("kind").isin("line", "comment", "blank")
    shown = is_code | (F.lit(keep_comments) & (F.col("kind") == "comment"))
    head = F.min(F.when(is_code, F.col("pos"))).over(Window.partitionBy(row_id, "line"))
    rows = rows.withColumn("head", head)
    string_first = (F.col("kind") == "string") & ((F.col("pos") == F.col("head")) | (F.col("before") == "\n"))
    width = F.length(F.regexp_replace(F.substring("t", 2, 1 << 20), "\t", " " * 8))
    per_line = rows.groupBy(row_id, "line").agg(
        F.max(F.when(ends, width)).alias("width"), F.count(F.when(is_code, 1)).alias("n"),
        F.count(F.when(F.col("kind") == "string", 1)).alias("strings"),
        F.array_sort(F.collect_list(F.when(shown, F.struct("pos", F.col("kind"), text.alias("x"))))).alias("shown"),
        F.array_sort(F.collect_list(F.when((F.col("kind") != "comment") & ~string_first, F.struct("pos", "t")))).alias("rest"),
        (F.max((F.col("kind") == "bad").cast("int")) + F.min(F.least("depth", F.lit(0))) * -1).alias("bad"),
        F.max_by("depth", "pos").alias("depth"))
    only = (F.col("n") == 1) & (F.col("strings") == 1)
    tokens = F.transform(F.filter("shown", lambda x: ~(only & (x["kind"] == "string"))), lambda x: x["x"])
    tokens = F.when((F.col("n") > 0) & ~only, F.concat(tokens, F.array(F.lit("NEW_LINE")))).otherwise(tokens)
    line = F.struct("line", F.col("width").alias("width"), (F.col("n") > 0).alias("code"), only.alias("doc"), tokens.alias("tokens"))
    out = per_line.groupBy(row_id).agg(
        F.array_sort(F.collect_list(F.when(F.size("shown") > 0, line))).alias("lines"),
        F.array_sort(F.collect_list(F.struct("line", F.array_join(F.transform("rest", lambda x: x["t"]), "").alias("t")))).alias("rest"),
        F.sum("bad").alias("bad"), F.max_by("depth", "line").alias("depth"))
    out = out.select(row_id, "bad", "depth", _marked(F.col("lines")).alias("m"),
                     F.array_join(F.transform("rest", lambda x: x["t"]), "").alias("rest"))
    good = (F.col("bad") == 0) & (F.col("depth") == 0) & F.col("m.good")
    stripped = F.array_join(F.filter(F.split("rest", "\n"), lambda x: F.trim(x) != ""), "\n")
    return out.select(row_id, F.when(good, "ok").otherwise("err").alias("status"),
                      F.when(good, F.filter("m.tokens", lambda t: t != "")).alias("tokens"), F.when(good, stripped).alias("stripped"))
