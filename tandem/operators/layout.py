"""From token strings back to laid-out source.

Lines are exploded, their depth is a running sum per document, and they are joined
again in order; a document is never larger than the row it came from.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.text import (C_FAMILY_SYMBOLS, C_SEGMENTS, PY_SEGMENTS, escape_symbols, replace_all,
                                   restore_symbols, strip, words)

# Brace layout markers, in order.
BRACE_STEPS = [("\n", "NEW_LINE"), ('} "', 'CB_ "'), ('" {', '" OB_'), ("*/ ", "*/ NEW_LINE"),
               ("} ;", "CB_COLON NEW_LINE"), ("} ,", "CB_COMA"), ("}", "CB_ NEW_LINE"), ("{", "OB_ NEW_LINE"),
               (";", "; NEW_LINE")]
BRACE_FINISH = [("CB_COLON", "};"), ("CB_COMA", "},"), ("CB_", "}"), ("OB_", "{"), ("> > >", ">>>"),
                ("<< <", "<<<"), ("> >", ">>"), ("< <", "<<")]
# Python layout fixes, in order.
STRING_MODIFIERS = ["r", "u", "f", "rf", "fr", "b", "rb", "br"]
BLOCK_FINISH = (
    [(". ", "."), (" .", "."), ("import.", "import ."), ("from.", "from .")]
    + [(f" {m} {q}", f" {m}{q}") for m in STRING_MODIFIERS + [x.upper() for x in STRING_MODIFIERS] for q in "'\""]
    + [("> >", ">>"), ("< <", "<<")]
)


def running_depth(df: DataFrame, row_id: str, pos: str, delta: str, name: str = "depth") -> DataFrame:
    """Running sum of ``delta`` that never falls below zero, including the current row."""
    w = Window.partitionBy(row_id).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("__s", F.sum(delta).over(w))
    return summed.withColumn(name, (F.col("__s") - F.least(F.min("__s").over(w), F.lit(0))).cast("int")).drop("__s")


def _join_lines(df: DataFrame, row_id: str, pos: str, line: str) -> DataFrame:
    rows = df.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct(pos, line))).alias("x"))
    return rows.select(row_id, F.array_join(F.transform("x", lambda r: r[line]), "\n").alias("text"))


def brace_text(code: Column) -> Column:
    """Restore literals and comments, normalize blanks between tokens, mark line breaks."""
    parts = F.regexp_extract_all(F.replace(code, F.lit("ENDCOM"), F.lit("\n")), F.lit(C_SEGMENTS), F.lit(0))

    def one(s: Column) -> Column:
        comment = (F.startswith(s, F.lit("//")) | F.startswith(s, F.lit("/*"))) & (F.length(s) > 1)
        literal = (F.startswith(s, F.lit('"')) | F.startswith(s, F.lit("'"))) & (F.length(s) > 1)
        body = escape_symbols(replace_all(s, [("STRNEWLINE", "\n"), ("TABSYMBOL", "\t")]), C_FAMILY_SYMBOLS)
        body = replace_all(body, [(" ", ""), ("▁", " ")])
        return (F.when(comment, F.concat(body, F.lit("\n"))).when(literal, body)
                .otherwise(F.array_join(words(s), " ")))

    joined = F.array_join(F.filter(F.transform(parts, one), lambda x: x != ""), " ")
    return restore_symbols(replace_all(joined, BRACE_STEPS), C_FAMILY_SYMBOLS)


def reindent_braces(df: DataFrame, row_id: str, code: str) -> DataFrame:
    """Tokenized brace code as indented text, two blanks a level."""
    lines = df.select(row_id, F.posexplode_outer(F.split(brace_text(F.col(code)), "NEW_LINE")).alias("pos", "raw"))
    lines = lines.withColumn("line", strip(F.col("raw")))
    closes, opens = F.startswith("line", F.lit("CB_")), F.endswith("line", F.lit("OB_"))
    lines = lines.withColumn("delta", F.when(closes, -1).when(opens, 1).otherwise(0))
    deep = running_depth(lines, row_id, "pos", "delta")
    level = F.col("depth") - F.when(F.col("delta") == 1, 1).otherwise(0)
    placed = deep.withColumn("line", F.concat(F.repeat(F.lit("  "), level), F.col("line")))
    return _join_lines(placed, row_id, "pos", "line").withColumn("text", replace_all(F.col("text"), BRACE_FINISH))


def _python_literals(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(PY_SEGMENTS), F.lit(0))

    def one(s: Column) -> Column:
        quoted = F.rlike(s, F.lit("^[\"'#]")) & (F.length(s) > 1)
        body = replace_all(s, [("STRNEWLINE", "\n"), ("TABSYMBOL", "\t"), (" ", ""), ("SPACETOKEN", " ")])
        return F.when(quoted, body).otherwise(s)

    return F.array_join(F.transform(parts, one), "")


def reindent_blocks(df: DataFrame, row_id: str, code: str) -> DataFrame:
    """Tokenized Python as indented text, four blanks a level."""
    start = replace_all(F.col(code), [("ENDCOM", "NEW_LINE"), ("▁", "SPACETOKEN")])
    lines = df.select(row_id, F.posexplode_outer(F.split(start, "NEW_LINE")).alias("pos", "raw"))
    lines = lines.withColumn("line", strip(F.col("raw")))
    deeper, back = F.startswith("line", F.lit("INDENT ")), F.startswith("line", F.lit("DEDENT"))
    steps = F.size(F.split("line", "DEDENT")) - 1
    lines = lines.withColumn("delta", F.when(deeper, 1).when(back, -steps).otherwise(0))
    deep = running_depth(lines, row_id, "pos", "delta").withColumn("tabs", F.repeat(F.lit("    "), F.col("depth")))
    placed = deep.withColumn("line", F.when(deeper, F.replace("line", F.lit("INDENT "), F.col("tabs"))).when(
        back, F.concat("tabs", strip(F.replace("line", F.lit("DEDENT"), F.lit(""))))).otherwise(
        F.concat("tabs", "line")))
    text = _join_lines(placed, row_id, "pos", "line")
    return text.withColumn("text", replace_all(_python_literals(F.col("text")), BLOCK_FINISH))
