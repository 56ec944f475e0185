"""Text and token-array expressions. All of them stay inside the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.split() sees it, written for Java and RE2 alike.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"

# Docstring token pattern.
DOCSTRING = (
    r"[^\s,'\"`.():\[\]=*;>{}+\-/,.\\]+|\\+|\.+|\(\)|\{\}|\[\]|\(+|\)+|:+|\[+|\]+|\{+|\}+"
    r"|=+|\*+|;+|>+|\++|-+|/+"
)

# Words or single punctuation marks, Unicode aware in both dialects.
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^" + SPACE + r"\p{L}\p{N}_]"

# Mteval clean-up steps, in order.
MTEVAL_JOIN = [("<skipped>", ""), ("-\n", ""), ("\n", " ")]
MTEVAL_ENTITIES = [("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&amp;", "&")]
MTEVAL_SPLIT = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " {1} "),
    (r"([^0-9])([\.,])", "{1} {2} "),
    (r"([\.,])([^0-9])", " {1} {2}"),
    (r"([0-9])(-)", "{1} {2} "),
]

# International punctuation split.
INTL_SPLIT = [
    (r"(\P{N})(\p{P})", "{1} {2} "),
    (r"(\p{P})(\P{N})", " {1} {2}"),
    (r"(\p{S})", " {1} "),
]

# Control tokens that stand for blanks inside strings.
BLANK_TOKENS = [(" ", " ▁ "), ("\n", " STRNEWLINE "), ("\t", " TABSYMBOL ")]

# Character sequences and their stand-in tokens, brace languages.
C_FAMILY_SYMBOLS = [
    ("//", "STOKEN00"), ("/*", "STOKEN01"), ("*/", "STOKEN02"), ("/**", "STOKEN03"),
    ("**/", "STOKEN04"), ('"""', "STOKEN05"), ("\\n", "STOKEN06"), ("\\r", "STOKEN07"),
    (";", "STOKEN08"), ("{", "STOKEN09"), ("}", "STOKEN10"), ("\\'", "STOKEN11"),
    ('\\"', "STOKEN12"), ("\\\\", "STOKEN13"),
]

# The same for Python.
PYTHON_SYMBOLS = [("#", "STOKEN00"), ("\\n", "STOKEN1"), ('"""', "STOKEN2"), ("'''", "STOKEN3")]

# Preprocessor lines removed from tokenized C++, in order.
DIRECTIVES = [
    r'# include ".*?"',
    r"# include <.*?>",
    r"# ifndef [^ ]*",
    r"# ifdef [^ ]*",
    r"# define [^ ]* \( .*? \) \( .* \)",
    r"# define [^ ]* \( .*? \) \{ .* \}",
    r'# define [^ ]* (\( )?".*?"( \))?',
    r"# define [^ ]* (\( )?\d*\.?\d*( [+-/*] ?\d*\.?\d*)?( \))?",
    r"# define [^ ]",
    r"# if defined \( .*? \)",
    r"# if [^ ]*",
]
DIRECTIVE_WORDS = ["# else", "# endif"]

# Leading Java annotations.
ANNOTATIONS = r"^(@ (Override|Deprecated|SuppressWarnings) (\( .* \) )?)*"

# Marks of Python 2 code.
LEGACY_PATTERNS = [r"print [^(]", r"raise [\p{L}\p{N}_]+ ,", r"except [\p{L}\p{N}_]+ ,", r"[^ ]+ = \p{Nd}+ L"]
LEGACY_CALLS = [". iterkeys ( )", ". itervalues ( )", ". iteritems ( )", "xrange (", "imap ("]


def empty_tokens() -> Column:
    return F.array().cast("array<string>")


def java_repl(template: str) -> str:
    return template.replace("{1}", "$1").replace("{2}", "$2")


def re2_repl(template: str) -> str:
    return template.replace("{1}", r"\1").replace("{2}", r"\2")


def rewrite(c: Column, steps: list[tuple[str, str]]) -> Column:
    """Pattern replacements, one after another; only a line feed ends a line."""
    return reduce(lambda acc, s: F.regexp_replace(acc, "(?d)" + s[0], java_repl(s[1])), steps, c)


def replace_all(c: Column, steps: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    return reduce(lambda acc, s: F.replace(acc, F.lit(s[0]), F.lit(s[1])), steps, c)


def bind(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` computed once per row, however often ``fn`` mentions it.

    The start of an aggregate over nothing: unlike ``transform`` it does not copy what ``fn`` returns.
    """
    return F.aggregate(F.array().cast("array<int>"), c, lambda x, _: x, fn)


# ---- tokens ---------------------------------------------------------------

def words(c: Column) -> Column:
    """Split on white space, without empty tokens.

    Other white space becomes blanks first: Spark splits by a blank without a pattern, and
    would compile any other pattern again for every row.
    """
    return F.array_remove(F.split(F.regexp_replace(c, f"[{SPACE}&&[^ ]]", " "), " "), "")


def docstring_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(DOCSTRING), F.lit(0))


def word_marks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD_OR_MARK), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of blanks become one blank; ends are trimmed of white space."""
    return strip(F.regexp_replace(c, "[\n\r\t ]+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def mteval_tokens(c: Column) -> Column:
    """mteval v11 normalization, lower-cased, as a token array."""
    joined = replace_all(c, MTEVAL_JOIN)
    plain = F.lower(F.concat(F.lit(" "), replace_all(joined, MTEVAL_ENTITIES), F.lit(" ")))
    return words(rewrite(plain, MTEVAL_SPLIT))


def nl_tokens(c: Column) -> Column:
    """Tokens of the natural-language metric: lower-case, split marks, then mteval."""
    return mteval_tokens(F.array_join(word_marks(F.lower(strip(c))), " "))


def parse_flag(c: Column) -> Column:
    """Boolean from off/false/0 and on/true/1 in any case; null for anything else."""
    return F.when(F.lower(c).isin("off", "false", "0"), False).when(F.lower(c).isin("on", "true", "1"), True)


# ---- strings and comments -------------------------------------------------

def escape_blanks(c: Column) -> Column:
    return replace_all(c, BLANK_TOKENS)


def escape_symbols(c: Column, symbols: list[tuple[str, str]]) -> Column:
    return replace_all(c, [(s, f" {t} ") for s, t in symbols])


def restore_symbols(c: Column, symbols: list[tuple[str, str]]) -> Column:
    return replace_all(c, [(t, s) for s, t in symbols])


def intl_split(c: Column) -> Column:
    return F.trim(rewrite(c, INTL_SPLIT))


def _squeeze_blank(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def literal_tokens(c: Column, symbols: list[tuple[str, str]] = (), comment: bool = False) -> Column:
    """A string literal or comment as blank-separated pieces.

    Comments also lose repeated blanks, have character runs cut to five, become
    empty below two word characters, and end in ``ENDCOM``.
    """
    symbols = list(symbols)

    def end_comment(body: Column) -> Column:
        at = F.locate(" STRNEWLINE ", body)
        cut = F.concat(F.substring(body, F.lit(1), at - 1), F.lit(" ENDCOM"),
                       F.substring(body, at + 12, F.length(body)))
        ended = F.when(at > 0, cut).otherwise(F.concat(body, F.lit(" ENDCOM")))
        return F.when(F.startswith(F.trim(body), F.lit("STOKEN00")), ended).otherwise(body)

    def pieces(t: Column) -> Column:
        body = escape_symbols(escape_blanks(t), symbols)
        if comment and symbols:
            body = bind(body, end_comment)
        out = _squeeze_blank(intl_split(_squeeze_blank(body)))
        return restore_symbols(F.replace(out, F.lit("\r"), F.lit("")), symbols)

    if not comment:
        return pieces(c)
    capped = F.regexp_replace(_squeeze_blank(c), r"(?d)(.)\1\1\1\1+", "$1$1$1$1$1")
    return bind(capped, lambda t: F.when(
        F.length(F.regexp_replace(t, r"[^\p{L}\p{N}_]", "")) < 2, F.lit("")).otherwise(pieces(t)))


def join_literal(c: Column) -> Column:
    """Undo the blank-separated form of a string."""
    return replace_all(c, [(" ", ""), ("▁", " ")])


def unsegment_bpe(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)(@@ )|(@@ ?$)", "")


def wrap(c: Column, width: int = 50) -> Column:
    return F.regexp_replace(c, f"(?s)(.{{{width}}})", "$1\n")


def strip_prefix(c: Column, prefixes: list[str]) -> Column:
    out = None
    for p in prefixes:
        hit, cut = F.startswith(c, F.lit(p)), strip(F.substring(c, len(p) + 1, 2147483647))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return c if out is None else out.otherwise(c)


def strip_annotations(c: Column) -> Column:
    return F.regexp_replace(c, "(?d)" + ANNOTATIONS, "")


def strip_directives(c: Column) -> Column:
    out = rewrite(c, [(p, "") for p in DIRECTIVES])
    return strip(replace_all(out, [(w, "") for w in DIRECTIVE_WORDS]))


def is_legacy_python(c: Column) -> Column:
    def tests(x: Column) -> Column:
        hits = [F.contains(x, F.lit(s)) for s in LEGACY_CALLS] + [F.rlike(x, F.lit(p)) for p in LEGACY_PATTERNS]
        return reduce(lambda a, b: a | b, hits)

    return bind(c, tests)


# Segments of source text: string literals, comments, plain runs. Possessive
# quantifiers keep the Java matcher's stack flat on very long literals.
_STR2 = r'"[^\\"]*+(?:\\.[^\\"]*+)*+"'
_STR1 = r"'[^\\']*+(?:\\.[^\\']*+)*+'"
C_SEGMENTS = rf"(?s)//[^\n]*|/\*.*?\*/|{_STR1}|{_STR2}|[^/'\"]+|."
PY_SEGMENTS = rf'(?s)""".*?"""|\'\'\'.*?\'\'\'|{_STR1}|{_STR2}|#[^\n]*|[^#\'"]+|.'


def _is_comment(s: Column) -> Column:
    return F.startswith(s, F.lit("//")) | (F.startswith(s, F.lit("/*")) & (F.length(s) > 1))


def drop_blank_lines(c: Column) -> Column:
    lines = F.split(c, "\n")
    return F.array_join(F.filter(lines, lambda x: strip(x) != ""), "\n")


def strip_comments(c: Column) -> Column:
    """Comments of brace languages become one blank; string literals are kept."""
    parts = F.regexp_extract_all(c, F.lit(C_SEGMENTS), F.lit(0))
    kept = F.transform(parts, lambda s: F.when(_is_comment(s), F.lit(" ")).otherwise(s))
    return drop_blank_lines(F.array_join(kept, ""))
