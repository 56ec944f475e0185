"""Registered queries over function spans and data-flow edges."""
from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions import text as X
from tandem.operators import scores
from tandem.operators import structure as S
from tandem.operators import trees as N
from tandem.plans import scoring
from tandem.plans import textops as T
from tandem.plans import textsql as Q
from tandem.plans import views as V
from tandem.plans.registry import ORACLES, query, table

SIDE = [*V.PAIR, "side"]


def _sql_brace_spans(code: str, cpp: bool = False) -> str:
    """Function spans in SQL over the CTE chain ``code``, which ends in ``brace`` (page_id, code)."""
    limits = "'{', '}', ';'" if cpp else "'{', '}', ';', '*/', 'ENDCOM'"
    head = "list_slice(d.t, g.start + 1, g.b)"
    free = f"list_contains({head}, 'static')"
    if cpp:
        free += f" OR (g.depth = 1 AND NOT list_contains(list_slice({head}, 1, list_position({head}, '(') - 1), '::'))"
    wanted = "coalesce(next, '}') <> '}'" if cpp else "place - (CASE WHEN t1 = ')' THEN 1 ELSE 3 END) + 3 < m"
    return rf"""WITH {code}, docs AS (SELECT page_id, {V.sql_words("code")} AS t FROM brace),
tok AS (SELECT page_id, unnest(t) AS tok, unnest(range(len(t)))::INT AS pos, len(t) AS n FROM docs WHERE len(t) > 0),
dep AS (SELECT *, sum(CASE tok WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS depth,
  max(CASE WHEN tok IN ({limits}) THEN pos END)
    OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lim,
  lag(tok) OVER w AS t1, lag(tok, 2) OVER w AS t2, lag(tok, 3) OVER w AS t3, lead(tok) OVER w AS next,
  row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY page_id) AS m FROM tok WHERE tok <> 'NEW_LINE'
  WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
opens AS (SELECT page_id, pos AS b, n, depth, lim + 1 AS start FROM dep
  WHERE tok = '{{' AND (t1 = ')' OR (t3 = ')' AND t2 = '{"throw" if cpp else "throws"}')) AND {wanted}),
closed AS (SELECT o.*, coalesce((SELECT min(d.pos) FROM dep d WHERE d.page_id = o.page_id AND d.pos > o.b AND d.tok = '}}'
  AND d.depth = o.depth - 1), o.n - 1) AS stop FROM opens o),
outside AS (SELECT * FROM closed c WHERE NOT EXISTS (SELECT 1 FROM closed k WHERE k.page_id = c.page_id AND k.b < c.b AND k.stop >= c.b)),
good AS (SELECT * FROM outside o WHERE NOT EXISTS (SELECT 1 FROM outside k WHERE k.page_id = o.page_id AND k.b <= o.b AND k.start IS NULL))
SELECT g.page_id, g.start::INT AS start, g.stop::INT AS stop, CASE WHEN {free} THEN 'standalone'
  ELSE 'class' END AS kind, array_to_string(list_slice(d.t, g.start + 1, g.stop + 1), ' ') AS function
FROM good g JOIN docs d USING (page_id)"""


_LINED = f"""{T.SQL_BRACE_CODE.replace("brace AS", "plain AS")}, brace AS (SELECT page_id, replace(code, ') {{', ') NEW_LINE {{') AS code FROM plain)"""


@query("brace_spans", _sql_brace_spans(_LINED))
def brace_spans(spark, sf):
    """Some bodies open on a line of their own."""
    code = T.pages_code(spark, sf).select("page_id", X.words(F.replace("code", F.lit(") {"), F.lit(") NEW_LINE {"))).alias("t"))
    return S.brace_spans(code, "page_id", "t")


def _sql_sole(spans: str) -> str:
    return f"SELECT page_id, min(kind) AS kind, min(function) AS function FROM ({spans}) GROUP BY page_id HAVING count(*) = 1"


@query("sole_function", _sql_sole(ORACLES["brace_spans"]))
def sole_function(spark, sf):
    return S.sole_function(brace_spans(spark, sf), "page_id")


# A page's tags as C++: members inside and outside of their class, free and static functions, empty bodies.
_CPP = [("</", "}"), ("<li", "static int li ( int a , int b ) { a = b ;"), ("<p", "void A :: p ( ) { x ( ) ;"),
        ("<nav", "int nav ( ) { return 1 ;"), ("<ul", "void ul ( ) {"), ("<div", "class div {"), ("<", "void art ( int c ) { y ( ) ;")]
_CPP_TAGS = "</?(?:div|ul|li|p|nav|article|footer)[ >]"
_SQL_CPP = f"""brace AS (SELECT page_id, 'using namespace std ; ' || array_to_string(list_slice(list_transform(regexp_extract_all(html, '{_CPP_TAGS}'), lambda t:
  CASE {" ".join(f"WHEN t LIKE '{a}%' THEN '{b}'" for a, b in _CPP)} END), 1, 2 + page_id % 40), ' ') AS code FROM pages)"""


def cpp_spans(spark, sf):
    def code(t):
        out = None
        for start, text in _CPP:
            out = (F.when if out is None else out.when)(t.startswith(start), text)
        return out

    tags = F.slice(F.transform(F.regexp_extract_all("html", F.lit(_CPP_TAGS), F.lit(0)), code), F.lit(1),
                   (2 + F.col("page_id") % 40).cast("int"))
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("using namespace std ; "), F.array_join(tags, " ")).alias("code"))
    return S.brace_spans(pages.select("page_id", X.words(F.col("code")).alias("t")), "page_id", "t", language="cpp")


query("brace_spans_cpp", _sql_brace_spans(_SQL_CPP, cpp=True))(cpp_spans)


@query("sole_function_cpp", _sql_sole(ORACLES["brace_spans_cpp"]))
def sole_function_cpp(spark, sf):
    """C++ files that hold exactly one function, standalone or not."""
    return S.sole_function(cpp_spans(spark, sf), "page_id")


# ---- nesting trees ---------------------------------------------------------

_WORDS = ["import", "static", "int", "void", "throws", "class"]
_SQL_TREES = rf"""{T.SQL_BRACE_CODE}, docs AS (SELECT page_id, list_transform({V.sql_words("code")}, lambda t: CASE
  WHEN t IN ({", ".join(f"'{w}'" for w in _WORDS)}) THEN t WHEN regexp_full_match(t, '[\p{{L}}_$][\p{{L}}\p{{N}}_$]*') THEN 'id' ELSE t END) AS t FROM brace),
tok AS (SELECT page_id, unnest(t) AS tok, unnest(range(len(t)))::INT AS pos FROM docs WHERE len(t) > 0),
dep AS (SELECT *, sum(CASE WHEN tok IN ('(', '{{') THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth
  FROM tok WHERE tok IN ('(', ')', '{{', '}}')),
lev AS (SELECT *, CASE WHEN tok IN ('(', '{{') THEN depth ELSE depth + 1 END AS level FROM dep),
nxt AS (SELECT *, lead(tok) OVER w AS c, lead(pos) OVER w AS stop FROM lev WINDOW w AS (PARTITION BY page_id, level ORDER BY pos)),
spans AS (SELECT page_id, pos AS start, stop, level::INT AS depth FROM nxt WHERE (tok = '(' AND c = ')') OR (tok = '{{' AND c = '}}')
  UNION ALL SELECT page_id, 0, (len(t) - 1)::INT, 0 FROM docs WHERE len(t) > 0),
subtrees AS (SELECT page_id, start, stop, depth, sha256(array_to_string(list_slice(t, start + 1, stop + 1), ' ')) AS digest FROM spans JOIN docs USING (page_id))"""


def _subtrees(spark, sf):
    code = T.pages_code(spark, sf).select("page_id", X.words(F.col("code")).alias("t"))
    return N.subtrees(code, "page_id", "t", _WORDS)


@query("subtree_rows", f"WITH {_SQL_TREES} SELECT * FROM subtrees")
def subtree_rows(spark, sf):
    """Every bracketed part of a page's code by its shape."""
    return _subtrees(spark, sf)


@query("tree_overlap", f"""WITH {_SQL_TREES}, bag AS (SELECT page_id, digest, sum(h) AS h, sum(r) AS r FROM (
  SELECT page_id, digest, 1 AS h, 0 AS r FROM subtrees UNION ALL SELECT page_id - 1, digest, 0, 1 FROM subtrees) GROUP BY page_id, digest)
SELECT page_id, sum(CASE WHEN h > 0 THEN r ELSE 0 END)::BIGINT AS matched, sum(r)::BIGINT AS total,
  round(sum(CASE WHEN h > 0 THEN r ELSE 0 END) / nullif(sum(r), 0), 6) AS score FROM bag GROUP BY page_id""")
def tree_overlap(spark, sf):
    """Subtrees of the next page (the reference) that the page has too."""
    rows = _subtrees(spark, sf).select("page_id", "digest")
    sides = rows.withColumn("side", F.lit("hyp")).unionByName(rows.select((F.col("page_id") - 1).alias("page_id"), "digest", F.lit("ref").alias("side")))
    o = scores.overlap(sides, ["page_id"], ["digest"], ["page_id"], membership=True)
    return o.select("page_id", "matched", "total", F.round(scores.overlap_score(), 6).alias("score"))


@query("indent_spans", rf"""WITH {T.SQL_BLOCK_CODE}, docs AS (SELECT doc_id, {V.sql_words("code")} AS t FROM block),
tok AS (SELECT doc_id, unnest(t) AS tok, unnest(range(len(t)))::INT AS pos FROM docs WHERE len(t) > 0),
dep AS MATERIALIZED (SELECT doc_id, pos, tok, depth FROM (SELECT *, sum(CASE tok WHEN 'INDENT' THEN 1 WHEN 'DEDENT' THEN -1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM tok) WHERE tok IN ('def', 'DEDENT', 'INDENT')),
closed AS MATERIALIZED (SELECT a.doc_id, a.pos AS start, min(d.pos) AS stop FROM dep a LEFT JOIN dep d ON d.doc_id = a.doc_id
  AND d.tok = 'DEDENT' AND d.depth = a.depth AND d.pos > a.pos WHERE a.tok = 'def' GROUP BY a.doc_id, a.pos),
reach AS (SELECT *, max(coalesce(stop, 2147483647)) OVER (PARTITION BY doc_id ORDER BY start
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM closed),
cut AS (SELECT r.doc_id, start, stop, list_slice(t, start + 1, stop + 1) AS s FROM reach r JOIN docs d USING (doc_id)
  WHERE stop IS NOT NULL AND (reach IS NULL OR reach < start)),
f AS (SELECT doc_id, start, stop, CASE WHEN s[list_position(s, '(') + 1] = 'self' THEN 'class' ELSE 'standalone' END AS kind,
  array_to_string(s, ' ') AS function FROM cut WHERE list_contains(s, '('))
SELECT * FROM f WHERE NOT ({" OR ".join([f"regexp_matches(function, {Q.lit(p)})" for p in X.LEGACY_PATTERNS]
                                       + [f"contains(function, {Q.lit(c)})" for c in X.LEGACY_CALLS])})""")
def indent_spans(spark, sf):
    code = table(spark, sf, "documents").select("doc_id", X.words(T.block_code(F.col("text"))).alias("t"))
    return S.indent_spans(code, "doc_id", "t")


# ---- edges ----------------------------------------------------------------

_E = f"WITH {V.SQL_PAIRS}, {scoring.SQL_EDGES}"


@query("edge_prune", f"""{_E}, e AS (SELECT conv_id, turn, side, pos, var, CASE WHEN length(var) % 3 = 0 OR pos = 0 THEN 0
  WHEN pos = 1 OR rel = 'comesFrom' THEN 1 ELSE 2 END AS n FROM edges),
linked AS (SELECT conv_id, turn, side, pos FROM e WHERE n > 0 UNION SELECT conv_id, turn, side, pos - 1 FROM e WHERE n >= 1
  UNION SELECT conv_id, turn, side, pos - 2 FROM e WHERE n >= 2)
SELECT conv_id, turn, side, pos::INT AS pos, var FROM e JOIN linked USING (conv_id, turn, side, pos)""")
def edge_prune(spark, sf):
    """Words whose length is a multiple of three lose their parents first."""
    e = scoring.edge_items(V.pairs(spark, sf)).withColumn(
        "parent_pos", F.when(F.length("var") % 3 == 0, F.array().cast("array<int>")).otherwise(F.col("parent_pos")))
    return S.prune_edges(e, SIDE).select(*SIDE, "pos", "var")


@query("edge_merge", f"""{_E}, x AS (SELECT DISTINCT conv_id, turn, side, pos, var, rel, p FROM (
  SELECT conv_id, turn, side, pos, var, rel, unnest(CASE WHEN parents = '' AND pos = 0 THEN [NULL]
    ELSE string_split(parents, ' ') END) AS p FROM edges))
SELECT conv_id, turn, side, pos, min(var) AS var, min(rel) AS rel, coalesce(string_agg(p, ' ' ORDER BY p), '') AS parents
FROM x GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY conv_id, turn, side, pos"))
def edge_merge(spark, sf):
    """Edges arrive as one row per parent and are merged again."""
    e = scoring.edge_items(V.pairs(spark, sf))
    single = e.select(*SIDE, "pos", "var", "rel", F.explode_outer(F.arrays_zip("parents", "parent_pos")).alias("p")).select(
        *SIDE, "pos", "var", "rel", F.array_compact(F.array("p.parents")).alias("parents"),
        F.array_compact(F.array("p.parent_pos")).alias("parent_pos"))
    return S.merge_edges(single, SIDE).select(*SIDE, "pos", "var", "rel", F.array_join("parents", " ").alias("parents"))


@query("alpha_rename", f"""{_E}, twofold AS (SELECT conv_id, turn, side, pos, rel, var, CASE WHEN pos = 0 THEN [] ELSE string_split(parents, ' ') END AS parents
  FROM edges UNION ALL SELECT conv_id, turn, side, pos, rel, 'x' || var, [var] FROM edges WHERE pos % 5 = 2),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, side ORDER BY pos, rel, var, parents) AS edge FROM twofold),
u AS (SELECT conv_id, turn, side, edge, pos, rel, unnest(names) AS name, unnest(range(len(names))) AS slot
  FROM (SELECT *, list_concat(parents, [var]) AS names FROM e)),
f AS (SELECT conv_id, turn, side, name, row_number() OVER (PARTITION BY conv_id, turn, side ORDER BY min(edge * 1000 + slot)) - 1 AS k
  FROM u GROUP BY conv_id, turn, side, name)
SELECT conv_id, turn, side, pos, rel, string_agg('var_' || k, ' ' ORDER BY slot) AS names
FROM u JOIN f USING (conv_id, turn, side, name) GROUP BY conv_id, turn, side, edge, pos, rel""")
def alpha_rename(spark, sf):
    """Every fifth position has a second edge."""
    e = scoring.edge_items(V.pairs(spark, sf)).select(*SIDE, "pos", "rel", "var", "parents")
    more = e.filter("pos % 5 = 2").select(*SIDE, "pos", "rel", F.concat(F.lit("x"), "var").alias("var"), F.array("var").alias("parents"))
    r = S.alpha_rename(e.unionByName(more), SIDE)
    return r.select(*SIDE, "pos", "rel", F.array_join(F.concat("parents", F.array("var")), " ").alias("names"))


@query("last_definition", f"""{_E}, d AS (SELECT conv_id, turn, side, pos, var, rel = 'comesFrom' OR
  row_number() OVER (PARTITION BY conv_id, turn, side, var ORDER BY pos) = 1 AS def FROM edges)
SELECT conv_id, turn, side, pos, var, coalesce(max(CASE WHEN def THEN pos END) OVER (PARTITION BY conv_id, turn, side, var
  ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), pos) AS def_pos FROM d""")
def last_definition(spark, sf):
    e = scoring.edge_items(V.pairs(spark, sf)).select(*SIDE, "pos", "var", "rel")
    return S.last_definition(e, SIDE, "pos", "var", F.col("rel") == "comesFrom").select(*SIDE, "pos", "var", "def_pos")
