"""Registered queries over run results."""
from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import errors as E
from tandem.operators import ngrams as G
from tandem.operators import runs as R
from tandem.operators import scores as S
from tandem.plans import views as V
from tandem.plans.registry import query, table
from tandem.plans.textsql import lit

_KEPT = """won AS (SELECT problem_id, min(beam) AS won FROM runs WHERE status = 'success' GROUP BY 1),
kept AS (SELECT r.* FROM runs r LEFT JOIN won w USING (problem_id) WHERE w.won IS NULL OR r.beam <= w.won)"""
_OUTCOME = """outcomes AS (SELECT problem_id, CASE WHEN bool_or(status = 'success') THEN 'success'
    ELSE arg_min(status, beam) END AS outcome,
  bool_or(status = 'success' AND detail = 'identical to gold') AS identical, count(*) AS attempts
  FROM kept GROUP BY problem_id)"""
_RUNS = f"WITH {V.SQL_RUNS}, {_KEPT}, {_OUTCOME}"
_STATS = ", ".join(f"count(*) FILTER (outcome = '{s}') AS {s}" for s in R.STATUS)


@query("run_status", """WITH o AS (SELECT event_id, event_id % 11 = 0 AS timed_out,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN timed_out THEN 'timeout' WHEN event_id % 10 = 0 THEN 'error'
  WHEN k = 50 THEN 'success' ELSE 'failure' END AS status,
  CASE WHEN timed_out THEN NULL WHEN event_id % 10 = 0 THEN 'trace ' || event_id
  WHEN k = 50 THEN NULL ELSE 'x #Results: ' || k || ', 50' END AS detail FROM o""")
def run_status(spark, sf):
    k = F.get_json_object("props", "$.k")
    out = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, F.lit("Traceback"))
        .otherwise(F.concat(F.lit("x #Results: "), k, F.lit(", 50"))).alias("stdout"),
        F.concat(F.lit("trace "), "event_id").alias("stderr"), (F.col("event_id") % 11 == 0).alias("timed_out"))
    status, detail = R.run_status(F.col("stdout"), F.col("stderr"), F.col("timed_out"))
    return out.select("event_id", status.alias("status"), detail.alias("detail"))


@query("first_success_prefix", f"{_RUNS} SELECT problem_id, beam, status, detail FROM kept")
def first_success_prefix(spark, sf):
    return R.until_success(V.runs(spark, sf))


def _outcomes(spark, sf):
    return R.problem_outcome(R.until_success(V.runs(spark, sf)))


@query("problem_outcome", f"{_RUNS} SELECT problem_id, outcome, identical, attempts FROM outcomes")
def problem_outcome(spark, sf):
    return _outcomes(spark, sf)


@query("outcome_stats", f"""{_RUNS} SELECT {_STATS}, count(*) FILTER (identical) AS identical_gold,
count(*) AS total, count(*) FILTER (outcome <> 'script_not_found') AS total_evaluated FROM outcomes""")
def outcome_stats(spark, sf):
    return R.outcome_stats(_outcomes(spark, sf))


@query("comp_accuracy", f"""{_RUNS} SELECT count(*) FILTER (outcome = 'success') AS success,
round(count(*) FILTER (outcome = 'success') / greatest(count(*) FILTER (outcome <> 'script_not_found'), 1), 6)
AS comp_acc FROM outcomes""")
def comp_accuracy(spark, sf):
    return R.outcome_stats(_outcomes(spark, sf)).select("success", F.round(R.accuracy(), 6).alias("comp_acc"))


@query("success_per_beam", f"""{_RUNS}
SELECT beam, count(*) FILTER (won IS NULL OR beam < won OR (beam = won AND status = 'success')) AS tried,
  count(*) FILTER (beam = won) AS success, count(*) FILTER (beam > won) AS empty
FROM runs LEFT JOIN won USING (problem_id) GROUP BY beam""")
def success_per_beam(spark, sf):
    return R.success_per_beam(V.runs(spark, sf))


@query("beam_result_grid", f"""{_RUNS} SELECT problem_id, beam,
CASE WHEN beam > won THEN '' ELSE status || ' : ' || detail END AS result FROM runs LEFT JOIN won USING (problem_id)""")
def beam_result_grid(spark, sf):
    return R.beam_grid(V.runs(spark, sf))


@query("run_log", f"""{_RUNS} SELECT problem_id, beam, status || ' : ' || detail AS line FROM kept""")
def run_log(spark, sf):
    return R.run_log(V.runs(spark, sf))


@query("gold_identity", f"""WITH {V.SQL_COPIES}
SELECT doc_id, CASE WHEN hyp = ref THEN 'success' ELSE 'failure' END AS status,
  CASE WHEN hyp = ref THEN 'identical to gold' ELSE 'n/a' END AS detail FROM copies""")
def gold_identity(spark, sf):
    c = V.copies(spark, sf).withColumn("status", F.lit("failure")).withColumn("detail", F.lit("n/a"))
    return R.gold_identity(c).select("doc_id", "status", "detail")


@query("template_join", """WITH b AS (SELECT conv_id AS problem_id, turn AS beam, length(text) AS size,
  min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations WHERE role = 'user')
SELECT b.problem_id, b.beam, b.size, CASE WHEN t.item_id IS NULL THEN 'script_not_found' ELSE 'ready' END AS state,
  length(t.text) AS script_size FROM b LEFT JOIN benchmark t ON t.item_id = b.problem_id
WHERE t.item_id IS NOT NULL OR b.beam = b.first""")
def template_join(spark, sf):
    tries = table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        F.col("conv_id").alias("problem_id"), F.col("turn").alias("beam"),
        F.length("text").cast("long").alias("size"))
    scripts = table(spark, sf, "benchmark").select(F.col("item_id").alias("problem_id"),
                                                   F.col("text").alias("script"))
    return R.template_join(tries, scripts).select(
        "problem_id", "beam", "size", "state", F.length("script").cast("long").alias("script_size"))


@query("comp_acc_by_pair", f"""{_RUNS}, o AS (SELECT *, problem_id % 3 AS pair FROM outcomes),
s AS (SELECT pair, count(*) FILTER (outcome = 'success') AS ok,
  count(*) FILTER (outcome <> 'script_not_found') AS tried, count(*) FILTER (identical) AS same FROM o GROUP BY pair)
SELECT 'once' AS counting, round(avg(ok / tried), 2) AS comp_acc FROM s
UNION ALL SELECT 'twice', round(avg(ok / (tried + same)), 2) FROM s""")
def comp_acc_by_pair(spark, sf):
    runs = V.runs(spark, sf).withColumn("pair", F.col("problem_id") % 3)
    stats = R.outcome_stats(R.problem_outcome(R.until_success(runs), ["pair"]), ["pair"])
    once = R.validation_accuracy(stats).select(F.lit("once").alias("counting"), "comp_acc")
    return once.unionByName(R.validation_accuracy(stats, True).select(F.lit("twice").alias("counting"), "comp_acc"))


@query("checkpoint_select", f"""WITH {V.SQL_RUNS}, {_KEPT}, {_OUTCOME}, {V.SQL_PAIRS}, {V.sql_stats("pairs", V.PAIR)},
cs AS (SELECT conv_id % 8 AS ck, m1, m2, m3, m4, hyp_len, ref_len, k1, ref_kw FROM stats),
corpus AS (SELECT ck, sum(hyp_len)::DOUBLE AS hyp_len, sum(ref_len)::DOUBLE AS ref_len,
  {", ".join(f"sum(m{n})::DOUBLE AS m{n}, sum(greatest(hyp_len - {n - 1}, 0))::DOUBLE AS p{n}" for n in range(1, 5))}
  FROM cs GROUP BY ck),
acc AS (SELECT problem_id % 8 AS ck, count(*) FILTER (outcome = 'success')
  / greatest(count(*) FILTER (outcome <> 'script_not_found'), 1) AS acc FROM outcomes GROUP BY 1),
j AS (SELECT ck, acc, {V.sql_plain()} AS bleu FROM corpus JOIN acc USING (ck))
SELECT 'checkpoint_' || (ck + 1) * 500 AS checkpoint, ((ck + 1) * 500)::INT AS step, round(bleu, 2) AS bleu,
  round(acc * 100, 2) AS comp_acc, ck = (SELECT ck FROM j ORDER BY acc DESC, ck LIMIT 1) AS best FROM j""")
def checkpoint_select(spark, sf):
    name = F.concat(F.lit("checkpoint_"), (F.col("ck") + 1) * 500)
    stats = G.match_stats(V.token_pairs(spark, sf), V.PAIR).withColumn("ck", F.col("conv_id") % 8)
    bleu = S.corpus_stats(stats, ["ck"]).select("ck", S.bleu_plain().alias("bleu"))
    out = _outcomes(spark, sf).withColumn("ck", F.col("problem_id") % 8)
    acc = R.outcome_stats(out, ["ck"]).select("ck", R.accuracy().alias("comp_acc"))
    return R.checkpoint_table(bleu.join(acc, "ck").select(name.alias("checkpoint"), "bleu", "comp_acc"))


# ---- error taxonomy -------------------------------------------------------

# one message ending per compiler rule, and one that no rule knows
ENDINGS = [
    "error: incompatible types: x", "error: int required, but boolean found", "error: ; expected",
    "error: illegal start of expression", "java.lang.ArrayIndexOutOfBoundsException: 3",
    "error: variable x is already defined", "error: no suitable method found", "error: 'else' without 'if'",
    "error: cannot find symbol", "error: bad operand type", "error: not a statement",
    "error: unclosed string literal", "error: missing return statement",
    "error: invalid method declaration; return type required", "java.lang.StackOverflowError",
    "java.lang.StringIndexOutOfBoundsException", "java.lang.NumberFormatException",
    "java.lang.IllegalArgumentException", "error: unreachable statement", "error: integer number too large",
    "java.lang.NullPointerException", "java.lang.IndexOutOfBoundsException", "java.lang.ArithmeticException",
    "error: variable x might not have been initialized", "error: break outside switch or loop", "killed",
]
PY_ENDINGS = [*E.PYTHON_CLASSES, "killed"]


def messages(spark, sf, endings):
    """One message per document line; the line length picks the ending, every fourth line is no error."""
    line = table(spark, sf, "documents").select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    n = F.length("line")
    head = F.when(n % 4 == 0, F.lit("failure : ")).otherwise(F.lit(E.PREFIX))
    tail = F.get(F.array(*[F.lit(e) for e in endings]), n % len(endings))
    return line.select("doc_id", F.concat(head, F.col("line"), F.lit(" "), tail).alias("message"))


def _messages_sql(endings) -> str:
    items = ", ".join(lit(e) for e in endings)
    return f"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
messages AS (SELECT doc_id, CASE WHEN length(line) % 4 = 0 THEN 'failure : ' ELSE 'error : ' END || line || ' '
  || ([{items}])[1 + length(line) % {len(endings)}] AS message FROM lines)"""


def _case_sql(rules, col="message") -> str:
    whens = " ".join("WHEN " + " OR ".join(
        [f"contains({col}, {lit(t)})" for t in texts] + [f"regexp_matches({col}, {lit('(?-s)' + p)})" for p in pats])
        + f" THEN '{name}'" for name, _, texts, pats in rules)
    return f"CASE {whens} ELSE 'other' END"


def _counts_sql(rules) -> str:
    labels = ", ".join(f"'{r[0]}'" for r in rules)
    return f"""c AS (SELECT {_case_sql(rules)} AS class FROM messages WHERE message LIKE 'error : %')
SELECT l.class, count(c.class) AS n FROM (SELECT unnest([{labels}, 'other']) AS class) l
LEFT JOIN c ON c.class = l.class GROUP BY l.class UNION ALL SELECT 'total', count(*) FROM c"""


def _classified(spark, sf, endings, rules):
    m = E.error_lines(messages(spark, sf, endings), "message")
    return m.select("doc_id", E.classify(F.col("message"), rules).alias("class"))


@query("error_classes_simple", f"WITH {_messages_sql(PY_ENDINGS)}, {_counts_sql(E.PYTHON_RULES)}")
def error_classes_simple(spark, sf):
    return E.class_counts(_classified(spark, sf, PY_ENDINGS, E.PYTHON_RULES), E.PYTHON_RULES)


@query("error_classes_rules", f"WITH {_messages_sql(ENDINGS)}, {_counts_sql(E.COMPILER_RULES)}")
def error_classes_rules(spark, sf):
    return E.class_counts(_classified(spark, sf, ENDINGS, E.COMPILER_RULES), E.COMPILER_RULES)


_RUNTIME = ", ".join(f"'{r[0]}'" for r in E.COMPILER_RULES if r[1] == E.RUNTIME)


@query("error_type_rollup", f"""WITH {_messages_sql(ENDINGS)},
c AS (SELECT {_case_sql(E.COMPILER_RULES)} AS class FROM messages WHERE message LIKE 'error : %'),
t AS (SELECT class, CASE WHEN class IN ({_RUNTIME}) THEN 'Runtime Errors' ELSE 'Compilation Errors' END AS type
  FROM c WHERE class <> 'other')
SELECT coalesce(type, 'all') AS type, coalesce(class, 'all') AS class, count(*) AS n FROM t GROUP BY ROLLUP (type, class)""")
def error_type_rollup(spark, sf):
    out = E.type_rollup(_classified(spark, sf, ENDINGS, E.COMPILER_RULES), E.COMPILER_RULES)
    return out.fillna("all", ["type", "class"])


# a rule table of all three kinds over words of the corpus
CORPUS_RULES = [
    ("Articles", "closed", ["the ", "der ", "le "], [" la .* el "]),
    ("Copyright", "mark", [], ["[Cc]opyright .*", "[Ll]icen[sc]e"]),
    ("Address", "mark", ["@", "http"], []),
    ("Digits", "mark", [], ["[0-9]{3}"]),
    ("Links", "closed", ["and ", "und ", "et ", "y "], []),
]


@query("classify_rules", f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS message FROM documents),
c AS (SELECT doc_id, {_case_sql(CORPUS_RULES)} AS class FROM lines)
SELECT class, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c GROUP BY class""")
def classify_rules(spark, sf):
    line = table(spark, sf, "documents").select("doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    c = line.select("doc_id", E.classify(F.col("line"), CORPUS_RULES).alias("class"))
    # per document first, so that the distinct count is a plain sum
    per_doc = c.groupBy("class", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
