"""Inputs of the registered queries, derived from the given tables, in Spark and in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.text import SPACE, words
from tandem.plans.registry import table
from tandem.scale import attach, ranked, running_max

PAIR = ["conv_id", "turn"]


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn (hypothesis) and the assistant turn that follows it (reference)."""
    conv = table(spark, sf, "conversations")
    user = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("hyp"))
    answer = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return user.join(answer, PAIR)


def token_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select(*PAIR, words(F.col("hyp")).alias("hyp"), words(F.col("ref")).alias("ref"))


def copies(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the first document with the same first line: a star, not all pairs."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.sha2(F.substring_index("text", "\n", 1), 256).alias("opening"))
    first = docs.groupBy("opening").agg(F.min("doc_id").alias("rep_id"))
    member = attach(docs, first, ["opening"]).filter(F.col("doc_id") != F.col("rep_id"))
    rep = docs.select(F.col("doc_id").alias("rep_id"), F.col("text").alias("ref"))
    return attach(member, rep, ["rep_id"]).select("doc_id", "rep_id", F.col("text").alias("hyp"), "ref")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every assistant turn with the user turn it answers (the last one before it), as ``conv_id, turn, ref_no, ref``."""
    conv = table(spark, sf, "conversations")
    asked = conv.select(*PAIR, "role", F.when(F.col("role") == "user", F.col("turn")).alias("asked"))
    last = running_max(asked, ["conv_id"], "turn", "asked").filter(
        (F.col("role") == "assistant") & F.col("asked").isNotNull())
    text = conv.filter(F.col("role") == "assistant").select(*PAIR, F.col("text").alias("ref"))
    return attach(text, last.select(*PAIR, "asked"), PAIR).select(
        "conv_id", F.col("asked").alias("turn"), F.col("turn").alias("ref_no"), "ref")


def multi_ref(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every user turn that is answered, and the assistant turns up to the next user turn as its references."""
    refs = answers(spark, sf).select(*PAIR, "ref_no", words(F.col("ref")).alias("ref"))
    user = table(spark, sf, "conversations").filter(F.col("role") == "user").select(*PAIR, words(F.col("text")).alias("hyp"))
    return attach(user, refs.select(*PAIR).distinct(), PAIR), refs


BEAMS = 3


def beams(spark: SparkSession, sf: str) -> DataFrame:
    """Three ranked hypotheses for every answer: the turn it answers, and that without its first and its last word."""
    user = table(spark, sf, "conversations").filter(F.col("role") == "user").select(*PAIR, F.col("text").alias("asked"))
    both = attach(answers(spark, sf), user, PAIR)
    parts = [F.col("asked"), F.regexp_replace("asked", f"^[^{SPACE}]*[{SPACE}]", ""),
             F.regexp_replace("asked", f"[{SPACE}][^{SPACE}]*$", "")]
    return both.select("conv_id", F.col("ref_no").alias("turn"), "ref", F.posexplode(F.array(*parts)).alias("beam", "hyp"))


STATUS = ["success", "failure", "error", "timeout", "script_not_found"]
STATUS_OF = {"purchase": "success", "view": "failure", "error": "error", "click": "timeout",
             "signup": "script_not_found"}


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One attempt per event: the beam is the event's rank among its user's, by time and id.

    Ranked within hours, so a user with very many events is no single task.
    """
    events = table(spark, sf, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(s)) for e, s in STATUS_OF.items()])
    identical = (status == "success") & (F.col("event_id") % 5 == 0)
    tries = events.select(
        F.col("user_id").alias("problem_id"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "ts", "event_id",
        status.alias("status"),
        F.when(identical, "identical to gold").otherwise(F.col("event_id").cast("string")).alias("detail"))
    return ranked(tries, ["problem_id"], ["day", "hour"], ["ts", "event_id"], "beam").select(
        "problem_id", "beam", "status", "detail")


# ---- the same inputs in SQL ----------------------------------------------

def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda t: t <> '')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


SQL_PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, a.text AS hyp, b.text AS ref
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""

SQL_COPIES = """first_doc AS (
  SELECT string_split(text, chr(10))[1] AS opening, min(doc_id) AS rep_id FROM documents GROUP BY 1),
copies AS (
  SELECT d.doc_id, f.rep_id, d.text AS hyp, r.text AS ref
  FROM documents d JOIN first_doc f ON string_split(d.text, chr(10))[1] = f.opening
  JOIN documents r ON r.doc_id = f.rep_id WHERE d.doc_id <> f.rep_id)"""

_SQL_ANSWERS = """answers AS (
  SELECT conv_id, asked AS turn, turn AS ref_no, text AS ref FROM (
    SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked
    FROM conversations) WHERE role = 'assistant' AND asked IS NOT NULL)"""

SQL_BEAMS = f"""{_SQL_ANSWERS},
asked AS (SELECT a.conv_id, a.ref_no AS turn, a.ref, c.text AS t FROM answers a
  JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn),
beams AS (SELECT conv_id, turn, 0 AS beam, t AS hyp, ref FROM asked
  UNION ALL SELECT conv_id, turn, 1, regexp_replace(t, '^[^{SPACE}]*[{SPACE}]', ''), ref FROM asked
  UNION ALL SELECT conv_id, turn, 2, regexp_replace(t, '[{SPACE}][^{SPACE}]*$', ''), ref FROM asked)"""

SQL_MULTI_REF = f"""{_SQL_ANSWERS},
refs AS (SELECT conv_id, turn, ref_no, {sql_words("ref")} AS ref FROM answers),
hyps AS (SELECT conv_id, turn, {sql_words("text")} AS hyp FROM conversations
  WHERE role = 'user' AND (conv_id, turn) IN (SELECT (conv_id, turn) FROM answers))"""

SQL_RUNS = """runs AS (
  SELECT user_id AS problem_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS beam,
         CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'failure'
           WHEN 'error' THEN 'error' WHEN 'click' THEN 'timeout' ELSE 'script_not_found' END AS status,
         CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'identical to gold'
              ELSE CAST(event_id AS VARCHAR) END AS detail
  FROM events)"""


def sql_stats(src: str, keys: list[str], max_n: int = 4, h: str = "hyp", r: str = "ref", tok=sql_words,
              keywords: list[str] = ()) -> str:
    """CTEs ending in ``stats``: lengths and clipped matches of every pair in ``src``."""
    k = ", ".join(keys)
    grams = " UNION ALL ".join(
        f"SELECT {k}, {s} AS side, {n} AS n, unnest(list_transform(range(1, greatest(len({c}) - {n - 2}, 1)), "
        f"lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' '))) AS g FROM toks"
        for n in range(1, max_n + 1) for s, c in ((1, "h"), (0, "r")))
    kw = ", ".join(f"'{w}'" for w in keywords) or "NULL"
    hits = ", ".join(f"sum(CASE WHEN n = {n} THEN least(ch, cr) ELSE 0 END)::BIGINT AS m{n}"
                     for n in range(1, max_n + 1))
    fill = ", ".join(f"coalesce(m{n}, 0) AS m{n}" for n in range(1, max_n + 1))
    return f"""toks AS MATERIALIZED (SELECT {k}, {tok(h)} AS h, {tok(r)} AS r FROM {src}),
grams AS ({grams}),
bags AS (SELECT {k}, n, g, sum(side) AS ch, sum(1 - side) AS cr FROM grams GROUP BY {k}, n, g),
hits AS (SELECT {k}, {hits},
  sum(CASE WHEN n = 1 AND g IN ({kw}) THEN least(ch, cr) ELSE 0 END)::BIGINT AS k1,
  sum(CASE WHEN n = 1 AND g IN ({kw}) THEN cr ELSE 0 END)::BIGINT AS ref_kw FROM bags GROUP BY {k}),
stats AS (SELECT {k}, len(toks.h) AS hyp_len, len(toks.r) AS ref_len, {fill},
  coalesce(k1, 0) AS k1, coalesce(ref_kw, 0) AS ref_kw FROM toks LEFT JOIN hits USING ({k}))"""


def sql_corpus(max_n: int = 4, by: str = "") -> str:
    """CTE ``corpus``: sums of ``stats``."""
    cols = ", ".join(f"sum(m{n})::DOUBLE AS m{n}, sum(greatest(hyp_len - {n - 1}, 0))::DOUBLE AS p{n}, "
                     f"sum(greatest(hyp_len - {n - 1}, 1))::DOUBLE AS q{n}, "
                     f"sum(greatest(ref_len - {n - 1}, 1))::DOUBLE AS r{n}" for n in range(1, max_n + 1))
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (f"corpus AS (SELECT {head}count(*)::DOUBLE AS pairs, sum(hyp_len)::DOUBLE AS hyp_len, "
            f"sum(ref_len)::DOUBLE AS ref_len, {cols}, sum(0.2 * m1 + 0.8 * k1)::DOUBLE AS wm1, "
            f"sum(greatest(0.2 * ref_len + 0.8 * ref_kw, 1))::DOUBLE AS wr1 FROM stats{tail})")


def sql_penalty(h: str = "hyp_len", r: str = "ref_len") -> str:
    return f"(CASE WHEN {h} > {r} THEN 1.0 WHEN {h} = 0 THEN 0.0 ELSE exp(1 - {r} / {h}) END)"


def sql_smoothed() -> str:
    logs = " + ".join(f"ln((m{n} + 1) / (p{n} + 1))" for n in range(1, 5))
    return f"(exp(({logs}) / 4) * (CASE WHEN hyp_len > ref_len THEN 1.0 ELSE exp(1 - ref_len / hyp_len) END))"


def sql_epsilon(weights=(0.25,) * 4) -> str:
    logs = " + ".join(f"{w} * ln((CASE WHEN m{n} = 0 THEN 0.1 ELSE m{n} END) / q{n})"
                      for n, w in enumerate(weights, 1))
    return f"(CASE WHEN m1 = 0 THEN 0.0 ELSE {sql_penalty()} * exp({logs}) END)"


def sql_plain() -> str:
    logs = " + ".join(f"ln(m{n} / p{n})" for n in range(1, 5))
    return (f"(CASE WHEN least(m1, m2, m3, m4) = 0 THEN 0.0 ELSE 100 * exp(({logs}) / 4) * "
            "(CASE WHEN hyp_len < ref_len THEN exp(1 - ref_len / hyp_len) ELSE 1.0 END) END)")


def sql_recall() -> str:
    logs = "ln(wm1 / wr1) + " + " + ".join(
        f"ln((CASE WHEN m{n} = 0 THEN 0.1 ELSE m{n} END) / r{n})" for n in range(2, 5))
    return f"(CASE WHEN wm1 = 0 THEN 0.0 ELSE {sql_penalty('hyp_len', '(2 * pairs)')} * exp(({logs}) / 4) END)"
