"""Error taxonomy: ordered rules, first hit wins, as one generated CASE expression."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import strip

PREFIX = "error : "

# Python error classes, in match order.
PYTHON_CLASSES = ["SyntaxError", "TypeError", "NameError", "UnboundLocalError", "AttributeError",
                  "ZeroDivisionError", "IndexError", "RecursionError", "KeyError", "ValueError", "OverflowError"]

# Compiler and JVM rules, in match order: class, type, texts, patterns.
COMPILE, RUNTIME = "Compilation Errors", "Runtime Errors"
COMPILER_RULES = [
    ("TypeError", COMPILE,
     ["error: incompatible types:", "error: incomparable types:", "error: unexpected type",
      "cannot be applied to given types", "error: char cannot be dereferenced", "error: int cannot be dereferenced",
      "error: boolean cannot be dereferenced"],
     ["error: .* required, but .* found", "error: .* type not allowed"]),
    ("SyntaxError", COMPILE, [], ["error: .* expected"]),
    ("IllegalStartOfExpression", COMPILE, ["error: illegal start of expression"], []),
    ("ArrayIndexOutOfBoundsException", RUNTIME, ["java.lang.ArrayIndexOutOfBoundsException"], []),
    ("VariableAlreadyDefined", COMPILE, [], ["error: variable .* is already defined"]),
    ("NoSuitableMethodFound", COMPILE, ["error: no suitable method found"], []),
    ("ElseWithoutIf", COMPILE, ["error: 'else' without 'if'"], []),
    ("CantFindSymbol", COMPILE, ["error: cannot find symbol"], []),
    ("BadOperand", COMPILE, ["error: bad operand type"], []),
    ("NotAStatement", COMPILE, ["error: not a statement"], []),
    ("UnclosedStringLiteral", COMPILE, ["error: unclosed string literal"], []),
    ("NoReturnStatement", COMPILE, ["error: missing return statement"], []),
    ("InvalidMethod", COMPILE, ["error: invalid method declaration; return type required"], []),
    ("StackOverflowError", RUNTIME, ["java.lang.StackOverflowError"], []),
    ("StringIndexOutOfBoundsException", RUNTIME, ["java.lang.StringIndexOutOfBoundsException"], []),
    ("NumberFormatException", RUNTIME, ["java.lang.NumberFormatException"], []),
    ("IllegalArgumentException", RUNTIME, ["java.lang.IllegalArgumentException"], []),
    ("UnreachableStatement", COMPILE, ["error: unreachable statement"], []),
    ("IntNumberTooLong", COMPILE, ["error: integer number too large"], []),
    ("NullPointerException", RUNTIME, ["java.lang.NullPointerException"], []),
    ("IndexOutOfBoundsException", RUNTIME, ["java.lang.IndexOutOfBoundsException"], []),
    ("ArithmeticException", RUNTIME, ["java.lang.ArithmeticException"], []),
    ("VariableNotInitialized", COMPILE, [], ["error: variable .* might not have been initialized"]),
    ("BreakOutsideSwitchOrLoop", COMPILE, ["error: break outside switch or loop"], []),
]
PYTHON_RULES = [(c, None, [c], []) for c in PYTHON_CLASSES]

Rule = tuple[str, str | None, Sequence[str], Sequence[str]]


def classify(message: Column, rules: Sequence[Rule], other: str | None = "other") -> Column:
    """The class of the first rule with a text contained in, or a pattern found in, the message."""
    out = None
    for name, _, texts, patterns in rules:
        # (?d): only \n ends a line
        tests = [F.contains(message, F.lit(t)) for t in texts]
        tests += [F.rlike(message, F.lit(f"(?d){p}")) for p in patterns]
        test = reduce(lambda a, b: a | b, tests)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(other))


def error_lines(df: DataFrame, text: str) -> DataFrame:
    """Messages that begin with the error mark, blanks in front aside."""
    return df.filter(F.startswith(strip(F.col(text)), F.lit(PREFIX)))


def class_counts(classified: DataFrame, rules: Sequence[Rule], name: str = "class") -> DataFrame:
    """One row per class (zero-filled), ``other`` and ``total``."""
    labels = [r[0] for r in rules] + ["other"]
    wide = classified.agg(
        *[F.coalesce(F.sum((F.col(name) == c).cast("long")), F.lit(0)).alias(c) for c in labels],
        F.count(F.lit(1)).alias("total"))
    return wide.unpivot([], [*labels, "total"], name, "n")


def type_of(name: Column, rules: Sequence[Rule]) -> Column:
    out = None
    for kind in dict.fromkeys(r[1] for r in rules):
        test = name.isin([r[0] for r in rules if r[1] == kind])
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out


def type_rollup(classified: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Counts per (type, class) with subtotals; unclassified messages are in neither type."""
    known = classified.filter(F.col("class") != "other").withColumn("type", type_of(F.col("class"), rules))
    return known.rollup("type", "class").agg(F.count(F.lit(1)).alias("n"))
