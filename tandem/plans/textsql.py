"""DuckDB spellings of the text expressions, for the oracles."""
from __future__ import annotations

from tandem.functions import text as T
from tandem.plans.views import sql_strip, sql_words


def lit(s: str) -> str:
    body = s.replace("'", "''")
    if any(ord(c) < 32 for c in body):
        body = body.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        return f"E'{body}'"
    return f"'{body}'"


def sql_replace(x: str, steps) -> str:
    for a, b in steps:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def sql_rewrite(x: str, steps) -> str:
    for p, r in steps:
        x = f"regexp_replace({x}, {lit(p)}, {lit(T.re2_repl(r))}, 'g')"
    return x


def sql_word_marks(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(T.WORD_OR_MARK)})"


def sql_mteval(x: str) -> str:
    x = sql_replace(sql_replace(x, T.MTEVAL_JOIN), T.MTEVAL_ENTITIES)
    return sql_rewrite(f"lower(' ' || {x} || ' ')", T.MTEVAL_SPLIT)


def sql_nl_tokens(x: str) -> str:
    return sql_words(sql_mteval(f"array_to_string({sql_word_marks(f'lower({sql_strip(x)})')}, ' ')"))


def sql_literal_tokens(x: str, symbols=()) -> str:
    """Non-comment string literal pieces."""
    x = sql_replace(sql_replace(x, T.BLANK_TOKENS), [(s, f" {t} ") for s, t in symbols])
    x = f"regexp_replace({x}, ' +', ' ', 'g')"
    x = f"regexp_replace(trim({sql_rewrite(x, T.INTL_SPLIT)}), ' +', ' ', 'g')"
    return sql_replace(f"replace({x}, {lit(chr(13))}, '')", [(t, s) for s, t in symbols])
