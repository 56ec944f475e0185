"""Registered queries over text, code tokens, layout and templates."""
from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions import arrays as A
from tandem.functions import text as X
from tandem.operators import layout as L
from tandem.operators import lexers as Z
from tandem.operators import templates as P
from tandem.plans import textsql as Q
from tandem.plans import views as V
from tandem.plans.registry import query, table

def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("docstring_tokens", f"""SELECT doc_id, array_to_string(regexp_extract_all(text, {Q.lit(X.DOCSTRING)}), ' ') AS tokens
FROM documents""")
def docstring_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(X.docstring_tokens(F.col("text")), " ").alias("tokens"))


_BLANKS = Q.lit("[" + chr(10) + chr(13) + chr(9) + " ]+")


@query("squeeze_ws", f"""SELECT doc_id, {V.sql_strip(f"regexp_replace(text, {_BLANKS}, ' ', 'g')")} AS text FROM documents""")
def squeeze_ws(spark, sf):
    return docs(spark, sf).select("doc_id", X.squeeze(F.col("text")).alias("text"))


@query("split_puncts", f"""SELECT doc_id, array_to_string({Q.sql_word_marks("lower(text)")}, ' ') AS tokens FROM documents""")
def split_puncts(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(X.word_marks(F.lower("text")), " ").alias("tokens"))


@query("mteval_normalize", f"""SELECT page_id, array_to_string({V.sql_words(Q.sql_mteval("html"))}, ' ') AS tokens FROM pages""")
def mteval_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(X.mteval_tokens(F.col("html")), " ").alias("tokens"))


_SYMBOLS = [(s, f" {t} ") for s, t in X.C_FAMILY_SYMBOLS]


@query("symbol_escape", f"""SELECT page_id, {Q.sql_replace(Q.sql_replace("html", X.BLANK_TOKENS), _SYMBOLS)} AS escaped,
{Q.sql_replace(Q.sql_replace(Q.sql_replace("html", X.BLANK_TOKENS), _SYMBOLS), [(t, s) for s, t in X.C_FAMILY_SYMBOLS])} AS back
FROM pages""")
def symbol_escape(spark, sf):
    e = X.escape_symbols(X.escape_blanks(F.col("html")), X.C_FAMILY_SYMBOLS)
    return table(spark, sf, "pages").select("page_id", e.alias("escaped"),
                                            X.restore_symbols(e, X.C_FAMILY_SYMBOLS).alias("back"))


def _comment_sql() -> str:
    body = Q.sql_replace(Q.sql_replace("t", X.BLANK_TOKENS), _SYMBOLS)
    tail = f"regexp_replace(trim({Q.sql_rewrite(chr(98), X.INTL_SPLIT)}), ' +', ' ', 'g')"
    back = Q.sql_replace(f"replace({tail}, chr(13), '')", [(t, s) for s, t in X.C_FAMILY_SYMBOLS])
    return f"""WITH src AS (SELECT doc_id, regexp_replace('// ' || replace(text, 'ou', 'oooooooou'), ' +', ' ', 'g') AS t FROM documents),
chars AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?s).')) AS c, unnest(range(1, length(t) + 1)) AS i FROM src),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM chars),
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c, g ORDER BY i) AS k FROM runs),
capped AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS t FROM nth WHERE k <= 5 OR c = chr(10) GROUP BY doc_id),
esc AS (SELECT doc_id, t, {body} AS b FROM capped),
com AS (SELECT doc_id, t, CASE WHEN b NOT LIKE 'STOKEN00%' AND b NOT LIKE ' STOKEN00%' AND trim(b) NOT LIKE 'STOKEN00%' THEN b
  WHEN strpos(b, ' STRNEWLINE ') > 0 THEN substr(b, 1, strpos(b, ' STRNEWLINE ') - 1) || ' ENDCOM'
    || substr(b, strpos(b, ' STRNEWLINE ') + 12) ELSE b || ' ENDCOM' END AS b FROM esc),
sq AS (SELECT doc_id, t, regexp_replace(b, ' +', ' ', 'g') AS b FROM com)
SELECT doc_id, CASE WHEN length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) < 2 THEN '' ELSE {back} END AS comment FROM sq"""


@query("comment_clean", _comment_sql())
def comment_clean(spark, sf):
    """Whole documents as line comments, with long character runs put in."""
    text = F.concat(F.lit("// "), F.replace("text", F.lit("ou"), F.lit("oooooooou")))
    return docs(spark, sf).select("doc_id", X.literal_tokens(text, X.C_FAMILY_SYMBOLS, comment=True).alias("comment"))


_LEX = Q.lit(Z.lexer(False))


@query("code_tokens_c", f"""WITH raw AS (SELECT page_id, unnest(regexp_extract_all(html, {_LEX})) AS t,
  unnest(range(len(regexp_extract_all(html, {_LEX})))) AS i FROM pages),
kept AS (SELECT * FROM raw WHERE NOT ((t LIKE '//%' OR t LIKE '/*%') AND length(t) > 1)),
cooked AS (SELECT page_id, i, CASE WHEN (t LIKE '"%' OR t LIKE '''%') AND length(t) > 1
  THEN {Q.sql_literal_tokens("t", X.C_FAMILY_SYMBOLS)} ELSE t END AS t FROM kept)
SELECT page_id, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS tokens FROM cooked WHERE t <> '' GROUP BY page_id""")
def code_tokens_c(spark, sf):
    t = table(spark, sf, "pages").select("page_id", Z.c_tokens(F.col("html")).alias("t"))
    return t.select("page_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


def python_source(doc_id, c):
    """Every line of a text as one statement of a small function; every tenth function has an open bracket."""
    body = F.array_join(F.transform(F.split(F.regexp_replace(c, "[\"\\\\]", ""), "\n"),
                                    lambda x: F.concat(F.lit('    x = f("'), x, F.lit('") # note'))), "\n")
    head = F.when(doc_id % 10 == 3, "def fun((a, b):").otherwise("def fun(a, b):")
    return F.concat(head, F.lit('\n    """doc"""\n'), body, F.lit("\n    return x\n"))


_PYSTR = Q.sql_literal_tokens("('\"' || line || '\"')", X.PYTHON_SYMBOLS)


@query("code_tokens_py", f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i
  FROM (SELECT doc_id, replace(replace(text, '"', ''), chr(92), '') AS t FROM documents)),
g AS (SELECT doc_id, 'def fun ( a , b ) : NEW_LINE INDENT ' || string_agg('x = f ( ' || {_PYSTR} || ' ) NEW_LINE', ' ' ORDER BY i)
  || ' return x NEW_LINE DEDENT' AS tokens, 'def fun(a, b):' || chr(10) || string_agg('    x = f("' || line || '") ', chr(10) ORDER BY i)
  || chr(10) || '    return x' AS stripped FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'err' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 10 <> 3 THEN tokens END AS tokens, CASE WHEN doc_id % 10 <> 3 THEN stripped END AS stripped FROM g""")
def code_tokens_py(spark, sf):
    src = docs(spark, sf).select("doc_id", python_source(F.col("doc_id"), F.col("text")).alias("code"))
    t = Z.python_tokens(src, "doc_id", "code")
    return t.select("doc_id", "status", F.array_join("tokens", " ").alias("tokens"), "stripped")


_ASIDE = [(", ", " /* aside, \"x\" */ "), (". ", "; \"a // b\" // note\n\n")]


@query("strip_comments", f"""WITH c AS (SELECT doc_id, {Q.sql_replace("text", _ASIDE)} AS code FROM documents),
p AS (SELECT doc_id, unnest(regexp_extract_all(code, {Q.lit('(?s)' + '//[^' + chr(92) + 'n]*|/' + chr(92) + '*.*?' + chr(92) + '*/|"[^"]*"|[^/"]+|.')})) AS s,
  unnest(range(len(regexp_extract_all(code, {Q.lit('(?s)' + '//[^' + chr(92) + 'n]*|/' + chr(92) + '*.*?' + chr(92) + '*/|"[^"]*"|[^/"]+|.')})))) AS i FROM c),
j AS (SELECT doc_id, string_agg(CASE WHEN s LIKE '//%' OR s LIKE '/*%' THEN ' ' ELSE s END, '' ORDER BY i) AS code FROM p GROUP BY doc_id)
SELECT doc_id, array_to_string(list_filter(string_split(code, chr(10)), lambda x: {V.sql_strip("x")} <> ''), chr(10)) AS code FROM j""")
def strip_comments(spark, sf):
    return docs(spark, sf).select("doc_id", X.strip_comments(X.replace_all(F.col("text"), _ASIDE)).alias("code"))


_NOTES = "@ Override @ SuppressWarnings ( x ) "


@query("strip_annotations", f"""SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '{_NOTES}' ELSE '@ Test ' END || text,
{Q.lit('(?-s)' + X.ANNOTATIONS)}, '') AS code FROM documents""")
def strip_annotations(spark, sf):
    code = F.concat(F.when(F.col("doc_id") % 2 == 0, _NOTES).otherwise("@ Test "), "text")
    return docs(spark, sf).select("doc_id", X.strip_annotations(code).alias("code"))


_HEAD = '# include <x.h> # include "y.h" # define N ( 10 ) # ifdef A # define F ( x ) ( x + 1 ) # if defined ( B ) '


@query("strip_directives", f"""WITH c AS (SELECT doc_id, {Q.lit(_HEAD)} || text || ' # else # endif' AS code FROM documents)
SELECT doc_id, {V.sql_strip(Q.sql_replace(Q.sql_rewrite("code", [("(?-s)" + p, "") for p in X.DIRECTIVES]), [(w, "") for w in X.DIRECTIVE_WORDS]))} AS code FROM c""")
def strip_directives(spark, sf):
    code = F.concat(F.lit(_HEAD), F.col("text"), F.lit(" # else # endif"))
    return docs(spark, sf).select("doc_id", X.strip_directives(code).alias("code"))


# ---- signatures: each document line becomes one function, its words the arguments ----

def signatures(spark, sf):
    line = docs(spark, sf).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("no", "line"))
    args = F.array_join(F.transform(X.words(F.regexp_replace("line", "[(),]", "")), lambda w, i: F.when(
        i % 3 == 0, F.concat(F.lit("int [ ] "), w)).otherwise(F.concat(F.lit("String "), w))), " , ")
    code = F.concat(F.lit("static int f"), "no", F.lit(" ( "), args, F.lit(" ) { return g ( 1 ) ; }"))
    return line.select("doc_id", "no", code.alias("code"), X.words(code).alias("t"))


_SIGS = f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10)))))::INT AS no FROM documents),
w AS (SELECT doc_id, no, {V.sql_words("regexp_replace(line, '[(),]', '', 'g')")} AS w FROM lines),
sigs AS (SELECT doc_id, no, w, array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN 'int [ ] ' || x
  ELSE 'String ' || x END), ' , ') AS args FROM w)"""


@query("function_name", f"WITH {_SIGS} SELECT doc_id, no, 'f' || no AS name, CASE WHEN len(w) = 0 THEN NULL ELSE w[1] END AS first_word FROM sigs")
def function_name(spark, sf):
    s = signatures(spark, sf)
    return s.select("doc_id", "no", A.name_before_paren(F.col("t")).alias("name"),
                    F.when(F.get("t", F.lit(4)) != ")", F.get("t", F.lit(7))).alias("first_word"))


@query("argument_list", f"""WITH {_SIGS} SELECT doc_id, no, CASE WHEN len(w) = 0 THEN 'None' ELSE
array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN 'int [ ]' ELSE 'String ' END), '|') END AS types,
CASE WHEN len(w) = 0 THEN 'None' ELSE array_to_string(w, '|') END AS names FROM sigs""")
def argument_list(spark, sf):
    s = signatures(spark, sf).withColumn("a", A.argument_list(F.col("t")))
    return s.select("doc_id", "no", F.array_join(F.transform("a", lambda x: x["type"]), "|").alias("types"),
                    F.array_join(F.transform("a", lambda x: x["name"]), "|").alias("names"))


@query("return_type", f"""WITH {_SIGS} SELECT doc_id, no, 'int' AS kind, 'Integer' AS boxed FROM sigs""")
def return_type(spark, sf):
    s = signatures(spark, sf).select("doc_id", "no", A.return_type(F.col("code")).alias("kind"))
    return s.withColumn("boxed", A.boxed_type(F.col("kind")))


def _filled_sql() -> str:
    f = "'static int area ( int area ) { return area ; }'"
    renamed = f"replace({f}, 'area', 'f_filled')"
    script = "replace(text, '. ', ' //TOFILL ')"
    py = "replace(text, '. ', ' #TOFILL ')"
    return f"""SELECT item_id, replace({script}, '//TOFILL', {renamed}) AS java,
{Q.lit(P.PYTHON_HEADER)} || replace({py}, '#TOFILL', {renamed}) AS python FROM benchmark"""


@query("fill_template", _filled_sql())
def fill_template(spark, sf):
    b = table(spark, sf, "benchmark")
    f = F.lit("static int area ( int area ) { return area ; }")
    name = A.name_before_paren(X.words(f))
    return b.select("item_id",
                    P.fill_template(F.replace("text", F.lit(". "), F.lit(" //TOFILL ")), f, name, "java").alias("java"),
                    P.fill_template(F.replace("text", F.lit(". "), F.lit(" #TOFILL ")), f, name, "python").alias("python"))


@query("adapter_source", f"""WITH {_SIGS} SELECT doc_id, no, CASE WHEN len(w) = 0 THEN NULL ELSE
'static int f_filled(' || array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 3 = 0
  THEN 'int   param' || (i - 1) || ' [ ]' ELSE 'String param' || (i - 1) END), ', ') || ')' || chr(10) || '{{' || chr(10)
|| 'return (int) f_filled_inner(' || array_to_string(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 3 = 0
  THEN '(char) param' || (i - 1) ELSE 'param' || (i - 1) || '.toCharArray()' END), ',') || ');' || chr(10) || '}}' END AS adapter
FROM sigs""")
def adapter_source(spark, sf):
    """The line's function as the script, the same with ``char`` arguments as the candidate."""
    s = signatures(spark, sf)
    mine = X.replace_all(F.col("code"), [("static int f", "static long f"), ("int [ ]", "char"), ("String", "char")])
    return s.select("doc_id", "no", P.adapter(F.col("code"), mine, "java").alias("adapter"))


@query("wrap_text", """SELECT doc_id, regexp_replace(text, '(?s)(.{50})', E'\\\\1\\n', 'g') AS text FROM documents""")
def wrap_text(spark, sf):
    return docs(spark, sf).select("doc_id", X.wrap(F.col("text")).alias("text"))


@query("unsegment_bpe", """SELECT doc_id, regexp_replace(replace(text, 'ou', 'o@@ u') || '@@ ', '(?m)(@@ )|(@@ ?$)', '', 'g') AS text FROM documents""")
def unsegment_bpe(spark, sf):
    seg = F.concat(F.replace("text", F.lit("ou"), F.lit("o@@ u")), F.lit("@@ "))
    return docs(spark, sf).select("doc_id", X.unsegment_bpe(seg).alias("text"))


# ---- layout ---------------------------------------------------------------

def brace_code(c, key):
    """Paired html tags as functions and classes; the page id decides whether something stands in front."""
    tags = F.regexp_extract_all(c, F.lit(r"</?(?:div|ul|li|p|nav|article|footer)[ >]"), F.lit(0))
    body = F.transform(tags, lambda t: F.when(F.startswith(t, F.lit("</")), "}")
                       .when(F.startswith(t, F.lit("<li")), "static int li ( int a , int b ) { a = b ;")
                       .when(F.startswith(t, F.lit("<p")), "void p ( ) throws Error { x ( ) ;")
                       .otherwise("class div {"))
    return F.concat(F.when(key % 7 != 0, F.lit("import a ; ")).otherwise(F.lit("")), F.array_join(body, " "))


SQL_BRACE_CODE = """brace AS (SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN 'import a ; ' ELSE '' END || array_to_string(
  list_transform(regexp_extract_all(html, '</?(?:div|ul|li|p|nav|article|footer)[ >]'), lambda t:
  CASE WHEN t LIKE '</%' THEN '}' WHEN t LIKE '<li%' THEN 'static int li ( int a , int b ) { a = b ;'
  WHEN t LIKE '<p%' THEN 'void p ( ) throws Error { x ( ) ;' ELSE 'class div {' END), ' ') AS code FROM pages)"""


def pages_code(spark, sf):
    return table(spark, sf, "pages").select("page_id", brace_code(F.col("html"), F.col("page_id")).alias("code"))


@query("reindent_braces", f"""WITH {SQL_BRACE_CODE},
m AS (SELECT page_id, {Q.sql_replace("code", L.BRACE_STEPS)} AS c FROM brace),
l AS (SELECT page_id, unnest(string_split(c, 'NEW_LINE')) AS line, unnest(range(len(string_split(c, 'NEW_LINE')))) AS i FROM m),
d AS (SELECT page_id, i, trim(line) AS line, CASE WHEN trim(line) LIKE 'CB!_%' ESCAPE '!' THEN -1
  WHEN trim(line) LIKE '%OB!_' ESCAPE '!' THEN 1 ELSE 0 END AS delta FROM l),
s AS (SELECT *, sum(delta) OVER (PARTITION BY page_id ORDER BY i) AS s FROM d),
f AS (SELECT *, s - least(min(s) OVER (PARTITION BY page_id ORDER BY i), 0) AS depth FROM s)
SELECT page_id, {Q.sql_replace("string_agg(repeat('  ', (depth - (delta = 1)::INT)::BIGINT) || line, chr(10) ORDER BY i)", L.BRACE_FINISH)} AS text
FROM f GROUP BY page_id""")
def reindent_braces(spark, sf):
    return L.reindent_braces(pages_code(spark, sf), "page_id", "code")


INDENT_STEPS = [("#", "%"), ("\n", " NEW_LINE DEDENT def f2 ( self ) : NEW_LINE INDENT return import . x NEW_LINE "),
                (", ", " : NEW_LINE INDENT "), (". ", " NEW_LINE DEDENT ")]


def block_code(c):
    """Text as indented blocks: each line a method, commas open a block, full stops close one."""
    return F.concat(F.lit("def f1 ( a ) : NEW_LINE INDENT "), X.replace_all(c, INDENT_STEPS), F.lit(" NEW_LINE DEDENT "))


SQL_BLOCK_CODE = f"""block AS (SELECT doc_id, 'def f1 ( a ) : NEW_LINE INDENT ' || {Q.sql_replace("text", INDENT_STEPS)}
  || ' NEW_LINE DEDENT ' AS code FROM documents)"""


@query("reindent_blocks", f"""WITH {SQL_BLOCK_CODE},
l AS (SELECT doc_id, unnest(string_split(code, 'NEW_LINE')) AS line, unnest(range(len(string_split(code, 'NEW_LINE')))) AS i FROM block),
t AS (SELECT doc_id, i, {V.sql_strip("line")} AS line FROM l),
d AS (SELECT doc_id, i, line, CASE WHEN line LIKE 'INDENT %' THEN 1 WHEN line LIKE 'DEDENT%'
  THEN -(length(line) - length(replace(line, 'DEDENT', ''))) // 6 ELSE 0 END AS delta FROM t),
s AS (SELECT *, sum(delta) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM d),
f AS (SELECT *, repeat('    ', (s - least(min(s) OVER (PARTITION BY doc_id ORDER BY i), 0))::BIGINT) AS tabs FROM s)
SELECT doc_id, {Q.sql_replace("string_agg(CASE WHEN line LIKE 'INDENT %' THEN replace(line, 'INDENT ', tabs) WHEN line LIKE 'DEDENT%' THEN tabs || "
                              + V.sql_strip("replace(line, 'DEDENT', '')") + " ELSE tabs || line END, chr(10) ORDER BY i)", L.BLOCK_FINISH)} AS text
FROM f GROUP BY doc_id""")
def reindent_blocks(spark, sf):
    code = docs(spark, sf).select("doc_id", block_code(F.col("text")).alias("code"))
    return L.reindent_blocks(code, "doc_id", "code")
