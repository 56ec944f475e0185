"""Registered queries over sources, filters and joins of corpus preparation."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions import arrays as A
from tandem.functions import text as X
from tandem.functions.hashing import uniform, uniform_sql
from tandem.operators import corpus as C
from tandem.plans import textsql as Q
from tandem.plans import views as V
from tandem.plans.registry import query, table
from tandem.scale import ranked
from tandem.sources import readers as R


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("corpus_scan", """SELECT doc_id::VARCHAR AS submission_id, source AS problem_id, length(text) AS size,
len(regexp_split_to_array(text, ' ')) AS pieces FROM documents""")
def corpus_scan(spark, sf):
    """JSON records with a fixed schema, written out and read back in the plan."""
    line = docs(spark, sf).select(F.to_json(F.struct(
        F.col("source").alias("problem_id"), F.col("doc_id").cast("string").alias("submission_id"),
        F.col("text").alias("code"))).alias("value"))
    rec = line.select(F.from_json("value", R.SUBMISSION).alias("r")).select("r.*")
    return rec.select("submission_id", "problem_id", F.length("code").cast("long").alias("size"),
                      F.size(F.split("code", " ")).cast("long").alias("pieces"))


@query("union_unimodal", """WITH u AS (SELECT 'bimodal' AS kind, text FROM conversations WHERE role = 'user'
UNION ALL SELECT 'unimodal', text FROM documents WHERE length(text) > 0)
SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM u GROUP BY kind""")
def union_unimodal(spark, sf):
    bi = table(spark, sf, "conversations").filter(F.col("role") == "user").select(F.lit("bimodal").alias("kind"), "text")
    uni = docs(spark, sf).filter(F.length("text") > 0).select(F.lit("unimodal").alias("kind"), "text")
    return bi.unionByName(uni).groupBy("kind").agg(F.count(F.lit(1)).alias("n"),
                                                   F.sum(F.length("text")).alias("chars"))


@query("metadata_status", """SELECT user_id AS problem_id, (event_id % 97) AS submission_id,
lower(arg_max(upper(event_type), event_id)) AS status FROM events GROUP BY ALL""")
def metadata_status(spark, sf):
    """The last event line per submission decides its status."""
    lines = table(spark, sf, "events").select(F.col("user_id").alias("problem_id"),
                                              (F.col("event_id") % 97).alias("submission_id"),
                                              F.upper("event_type").alias("status"), F.col("event_id").alias("line"))
    return R.latest_status(lines)


@query("path_basename", """SELECT DISTINCT regexp_replace(regexp_extract(url, '[^/]*$'), '^([.]*[^.].*)[.][^.]*$', '\\1')
AS submission_id FROM pages""")
def path_basename(spark, sf):
    return table(spark, sf, "pages").select(R.path_stem(F.col("url")).alias("submission_id")).distinct()


@query("block_first_member", r"""WITH b AS (SELECT doc_id, regexp_replace(text, '[.]\n', E'.\n\n \n', 'g') AS text FROM documents),
s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n([ \t]*\n)+')) AS block FROM b)
SELECT doc_id, regexp_extract(block, '[^\n]*\S[^\n]*') AS head FROM s WHERE regexp_matches(block, '\S')""".replace(
    "regexp_extract(block, '[^\\n]*\\S[^\\n]*')", "trim(regexp_extract(block, '[^\\n]*\\S[^\\n]*'))"))
def block_first_member(spark, sf):
    text = F.regexp_replace("text", r"[.]\n", ".\n\n \n")
    heads = F.transform(R.block_lines(text), lambda xs: xs[0])
    return docs(spark, sf).select("doc_id", F.explode_outer(heads).alias("head")).filter(F.col("head").isNotNull())


@query("split_id_code", """SELECT doc_id::VARCHAR AS id,
trim(regexp_replace(replace(text, ', ', ' | '), '[ \\t]+', ' ', 'g')) AS code,
trim(regexp_replace(string_split(replace(text, ', ', ' | '), '|')[1], '[ \\t]+', ' ', 'g')) AS legacy_code FROM documents""")
def split_id_code(spark, sf):
    line = docs(spark, sf).select(F.concat(F.col("doc_id"), F.lit(" | "), F.replace("text", F.lit(", "), F.lit(" | "))).alias("v"))
    ident, code = R.split_id_code(F.col("v"))
    return line.select(ident.alias("id"), code.alias("code"), R.split_id_code(F.col("v"), True)[1].alias("legacy_code"))


def gen_lines(spark, sf):
    """A generation log: sources and hypotheses of every turn, scored by turn."""
    conv = table(spark, sf, "conversations").withColumn("t", F.replace("text", F.lit("\n"), F.lit(" ")))
    hyp = F.concat(F.lit("H-"), "conv_id", F.lit("\t-"), F.col("turn") / 4, F.lit("\t"), "t")
    src = F.concat(F.lit("S-"), "conv_id", F.lit("\t"), "t")
    return conv.select(F.explode(F.array(src, hyp)).alias("value"))


@query("parse_gen_log", """SELECT conv_id AS id, -turn / 4 AS score, replace(text, chr(10), ' ') AS hypothesis,
regexp_replace(replace(text, chr(10), ' '), '^[^ ]* ?', '') AS untagged FROM conversations""")
def parse_gen_log(spark, sf):
    out = R.gen_log(gen_lines(spark, sf))
    return out.select("id", (F.col("score") + 0.0).alias("score"), "hypothesis",
                      F.regexp_replace("hypothesis", "^[^ ]* ?", "").alias("untagged"))


@query("nbest_deinterleave", """WITH r AS (SELECT conv_id AS id, turn, replace(text, chr(10), ' ') AS hypothesis,
row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS beam FROM conversations)
SELECT id, beam, 5 - ((beam + 1) % 5) - 1 AS legacy_file, hypothesis FROM r""")
def nbest_deinterleave(spark, sf):
    """Rank within an id by falling score; long lists are ranked in score bands."""
    log = R.gen_log(gen_lines(spark, sf)).withColumn("band", F.floor(-F.col("score")))
    out = ranked(log, ["id"], ["band"], [F.desc("score"), "hypothesis"], "beam")
    return out.select("id", "beam", (5 - (F.col("beam") + 1) % 5 - 1).alias("legacy_file"), "hypothesis")


@query("json_field", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
json_extract_string(props, '$.missing') AS missing FROM events""")
def json_field(spark, sf):
    rec = F.from_json("props", T.StructType([T.StructField("k", T.LongType()), T.StructField("missing", T.StringType())]))
    return table(spark, sf, "events").select("event_id", rec.alias("r")).select("event_id", "r.k", "r.missing")


@query("canonical_pair", """WITH p AS (SELECT lang AS s, (['de', 'en', 'es', 'fr'])[1 + n_chars % 4] AS t FROM documents)
SELECT least(s, t) || '-' || greatest(s, t) AS pair, count(*) AS n FROM p WHERE s <> t GROUP BY 1""")
def canonical_pair(spark, sf):
    other = F.get(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("n_chars") % 4).cast("int"))
    p = docs(spark, sf).select(F.col("lang").alias("s"), other.alias("t")).filter(F.col("s") != F.col("t"))
    return p.groupBy(R.canonical_pair(F.col("s"), F.col("t")).alias("pair")).agg(F.count(F.lit(1)).alias("n"))


# ---- fields and filters ---------------------------------------------------

_DOC_TOKENS = f"array_to_string(regexp_extract_all(text, {Q.lit(X.DOCSTRING)}), ' ')"
_SQUEEZE = f"{V.sql_strip('regexp_replace(d, {}, {}, {})'.format(Q.lit('[' + chr(10) + chr(13) + chr(9) + ' ]+'), Q.lit(' '), Q.lit('g')))}"


@query("field_coalesce", f"""WITH f AS (SELECT doc_id, CASE lang WHEN 'en' THEN array_to_string({V.sql_words("text")}, ' ')
  WHEN 'es' THEN NULL ELSE {_DOC_TOKENS} END AS d, CASE WHEN n_chars > 1000 THEN source ELSE lang END AS code FROM documents)
SELECT doc_id, {_SQUEEZE} AS docstring, code FROM f WHERE d IS NOT NULL""")
def field_coalesce(spark, sf):
    """English documents carry tokens, French and German ones a summary, Spanish ones neither."""
    lang = F.col("lang")
    rec = docs(spark, sf).select(
        "doc_id", F.when(lang == "en", X.words(F.col("text"))).alias("docstring_tokens"),
        F.when(lang.isin("fr", "de"), F.col("text")).alias("summary"),
        F.when(F.col("n_chars") > 1000, F.col("source")).alias("code"), lang.alias("function"))
    return rec.select("doc_id", C.docstring(F.col("docstring_tokens"), F.col("summary")).alias("docstring"),
                      C.code_field(F.col("code"), F.col("function")).alias("code")).filter("docstring IS NOT NULL")


@query("drop_empty_pairs", f"""WITH {V.SQL_PAIRS}, d AS (SELECT conv_id, turn,
  regexp_replace(hyp, '[^éèàç]', '', 'g') AS a, regexp_replace(ref, '[^éèàç]', '', 'g') AS b FROM pairs)
SELECT * FROM d WHERE length(a) > 0 AND length(b) > 0""")
def drop_empty_pairs(spark, sf):
    p = V.pairs(spark, sf).select(*V.PAIR, F.regexp_replace("hyp", "[^éèàç]", "").alias("a"),
                                  F.regexp_replace("ref", "[^éèàç]", "").alias("b"))
    return p.filter(C.non_empty("a", "b"))


# html as brace code: scripts and styles of the pages
_MARKS = Q.sql_word_marks("html")


@query("token_before_marker", f"""WITH t AS (SELECT page_id, {_MARKS} AS t FROM pages),
m AS (SELECT page_id, list_slice(t, 1, list_position(t, '{{') - 1) AS head FROM t WHERE list_contains(t, '{{'))
SELECT page_id, len(head) AS head_len, list_contains(head, 'static') AS is_static,
  list_contains(head, 'title') AS has_title FROM m""")
def token_before_marker(spark, sf):
    t = table(spark, sf, "pages").select("page_id", X.word_marks(F.col("html")).alias("t"))
    head = A.before_marker(F.col("t"), "{")
    return t.filter(F.array_contains("t", "{")).select(
        "page_id", F.size(head).cast("long").alias("head_len"), A.is_static(F.col("t")).alias("is_static"),
        F.array_contains(head, "title").alias("has_title"))


@query("token_after_marker", f"""WITH t AS (SELECT page_id, {_MARKS} AS t FROM pages)
SELECT page_id, t[list_position(t, '(') + 1] AS first_arg, t[list_position(t, '(') + 1] <> 'self' AS free_function
FROM t WHERE list_contains(t, '(')""")
def token_after_marker(spark, sf):
    t = table(spark, sf, "pages").select("page_id", X.word_marks(F.col("html")).alias("t"))
    return t.filter(F.array_contains("t", "(")).select(
        "page_id", A.after_marker(F.col("t"), "(").alias("first_arg"),
        A.is_free_function(F.col("t")).alias("free_function"))


def _legacy_text(c):
    return X.replace_all(c, LEGACY_STEPS)


LEGACY_STEPS = [(" la ", " print x "), (" und ", " xrange ( "), (" that ", " except E , ")]


@query("legacy_syntax_filter", f"""WITH c AS (SELECT doc_id, {Q.sql_replace("text", LEGACY_STEPS)} AS code FROM documents)
SELECT doc_id, {" OR ".join([f"regexp_matches(code, {Q.lit(p)})" for p in X.LEGACY_PATTERNS]
                            + [f"contains(code, {Q.lit(s)})" for s in X.LEGACY_CALLS])} AS legacy FROM c""")
def legacy_syntax_filter(spark, sf):
    return docs(spark, sf).select("doc_id", X.is_legacy_python(_legacy_text(F.col("text"))).alias("legacy"))


_LEN = f"t AS (SELECT doc_id, text, {V.sql_words('text')} AS t FROM documents)"


def _policies(spark, sf):
    t = docs(spark, sf).select("doc_id", "text", X.words(F.col("text")).alias("t"))
    strict = C.length_policy(t, ["t"], ["text"], 256, strict=True)
    return t, strict


@query("length_policy", f"""WITH {_LEN} SELECT doc_id, CASE WHEN len(t) = 0 THEN 'EMPTY'
WHEN len(t) > 256 THEN 'OVER_LENGTH' ELSE 'PASS' END AS strict_reason,
CASE WHEN len(t) = 0 THEN 'EMPTY' ELSE 'PASS' END AS reason,
array_to_string(CASE WHEN len(t) > 0 THEN list_slice(t, 1, 256) END, ' ') AS kept FROM t""")
def length_policy(spark, sf):
    t, _ = _policies(spark, sf)
    both = C.length_policy(t.withColumn("u", F.col("t")), ["u"], ["text"], 256, strict=True)
    loose = C.length_policy(both.withColumnRenamed("reason", "strict_reason"), ["t"], ["text"], 256)
    return loose.select("doc_id", "strict_reason", "reason", F.array_join("t", " ").alias("kept"))


@query("length_policy_pair", f"""WITH {V.SQL_PAIRS}, t AS (SELECT conv_id, turn, len({V.sql_words("hyp")}) AS a,
  len({V.sql_words("ref")}) AS b FROM pairs)
SELECT conv_id, turn, CASE WHEN a = 0 OR b = 0 THEN 'EMPTY' WHEN a > 100 OR b > 100 THEN 'OVER_LENGTH'
  ELSE 'PASS' END AS reason FROM t""")
def length_policy_pair(spark, sf):
    p = V.pairs(spark, sf).withColumn("a", X.words(F.col("hyp"))).withColumn("b", X.words(F.col("ref")))
    return C.length_policy(p, ["a", "b"], ["hyp", "ref"], 100, strict=True).select(*V.PAIR, "reason")


@query("filter_reason_counts", f"""WITH {_LEN}, r AS (SELECT CASE WHEN len(t) = 0 THEN 'EMPTY'
WHEN len(t) > 256 THEN 'OVER_LENGTH' ELSE 'PASS' END AS reason FROM t)
SELECT 'num_filtered_' || reason AS reason, count(*) AS n FROM r WHERE reason <> 'PASS' GROUP BY reason""")
def filter_reason_counts(spark, sf):
    return C.filter_reasons(_policies(spark, sf)[1])


@query("strip_prefix", f"""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'private : ' WHEN 1 THEN 'public : '
  ELSE '' END || text AS code FROM documents)
SELECT doc_id, CASE WHEN code LIKE 'private :%' THEN {V.sql_strip("substr(code, 10)")}
  WHEN code LIKE 'public :%' THEN {V.sql_strip("substr(code, 9)")} ELSE code END AS code FROM p""")
def strip_prefix(spark, sf):
    k = F.col("doc_id") % 3
    code = F.concat(F.when(k == 0, "private : ").when(k == 1, "public : ").otherwise(""), F.col("text"))
    return docs(spark, sf).select("doc_id", X.strip_prefix(code, ["private :", "public :"]).alias("code"))


@query("head_split", """SELECT doc_id, doc_id < 90000 AS in_train, doc_id < 2500 AS in_valid,
doc_id < 2781 AS in_test FROM documents""")
def head_split(spark, sf):
    return C.head_splits(docs(spark, sf).select("doc_id"), "doc_id")


@query("alignment_check", """WITH s AS (SELECT conv_id, count(*) FILTER (role = 'user') AS l,
count(*) FILTER (role = 'assistant') AS r FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
SELECT sum(l)::BIGINT AS left_rows, sum(r)::BIGINT AS right_rows, count(*) FILTER (l > 0 AND r > 0) AS both,
bool_and(l = r) AS aligned FROM s""")
def alignment_check(spark, sf):
    conv = table(spark, sf, "conversations")
    return C.alignment(conv.filter(F.col("role") == "user"), conv.filter(F.col("role") == "assistant"), ["conv_id"])


# ---- joins ----------------------------------------------------------------

def submissions(spark, sf):
    return docs(spark, sf).select(F.col("source").alias("problem_id"), F.col("doc_id").alias("submission_id"),
                                  F.col("text").alias("code"))


def metadata(spark, sf):
    lab = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "source"), "doc_id")
    return lab.select(F.col("source").alias("problem_id"), F.col("doc_id").alias("submission_id"),
                      F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("status"))


def _labelled(spark, sf, cond):
    return table(spark, sf, "labels").filter(cond).select(F.col("doc_id").alias("submission_id"))


@query("anti_join_ignored", """SELECT doc_id AS submission_id, source AS problem_id FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def anti_join_ignored(spark, sf):
    return submissions(spark, sf).select("submission_id", "problem_id").join(
        _labelled(spark, sf, F.col("toxic") == 1), "submission_id", "left_anti")


@query("anti_join_outliers", """SELECT doc_id AS submission_id, lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def anti_join_outliers(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").alias("submission_id"), "lang").join(
        _labelled(spark, sf, F.col("quality") == 0), "submission_id", "left_anti")


@query("semi_join_representative", """SELECT doc_id, source FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)""")
def semi_join_representative(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", "source").join(C.representatives(d, "doc_id", "text"), "doc_id", "left_semi")


@query("join_metadata", """SELECT d.source AS problem_id, d.doc_id AS submission_id,
CASE WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS status, length(d.text) AS size
FROM documents d JOIN labels l USING (doc_id)""")
def join_metadata(spark, sf):
    return submissions(spark, sf).join(metadata(spark, sf), ["problem_id", "submission_id"]).select(
        "problem_id", "submission_id", "status", F.length("code").cast("long").alias("size"))


@query("missing_metadata", """SELECT source AS problem_id, doc_id AS submission_id FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_metadata(spark, sf):
    return C.missing_metadata(submissions(spark, sf), metadata(spark, sf)).select("problem_id", "submission_id")


@query("submission_selection", """WITH reps AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
ignored AS (SELECT source FROM (SELECT source, count(*) FILTER (toxic = 1) AS bad FROM documents JOIN labels
  USING (doc_id) GROUP BY source) WHERE bad >= 4)
SELECT d.doc_id AS submission_id, d.source AS problem_id FROM documents d JOIN reps USING (doc_id)
JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0 AND length(d.text) > 0
AND d.source NOT IN (SELECT source FROM ignored)""")
def submission_selection(spark, sf):
    subs = submissions(spark, sf)
    toxic = table(spark, sf, "labels").filter(F.col("toxic") == 1)
    bad = toxic.join(docs(spark, sf).select("doc_id", F.col("source").alias("problem_id")), "doc_id").groupBy(
        "problem_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 4).select("problem_id")
    reps = C.representatives(subs, "submission_id", "code")
    kept = C.select_submissions(subs, metadata(spark, sf), bad, _labelled(spark, sf, F.col("toxic") == 1), reps,
                                "accepted")
    return kept.select("submission_id", "problem_id")


@query("pair_join", f"""WITH {V.SQL_PAIRS} SELECT conv_id, turn, hyp, ref FROM pairs""")
def pair_join(spark, sf):
    return V.pairs(spark, sf)


SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}
_U = uniform_sql(7, "doc_id")


@query("split_overlap", f"""WITH s AS (SELECT text, CASE WHEN {_U} < 0.8 THEN 'train' WHEN {_U} < 0.9 THEN 'valid'
  ELSE 'test' END AS split FROM documents),
d AS (SELECT text, bool_or(split = 'train') AS a, bool_or(split = 'valid') AS b, bool_or(split = 'test') AS c
  FROM s GROUP BY text)
SELECT 'train/valid' AS splits, count(*) FILTER (a AND b) AS texts FROM d
UNION ALL SELECT 'train/test', count(*) FILTER (a AND c) FROM d
UNION ALL SELECT 'valid/test', count(*) FILTER (b AND c) FROM d""")
def split_overlap(spark, sf):
    d = docs(spark, sf).select("text", C.hash_split(uniform(7, F.col("doc_id")), SHARES).alias("split"))
    return C.split_overlap(d, "text", "split", list(SHARES))


_VOCAB = f"""toks AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos
  FROM (SELECT doc_id, {V.sql_words("text")} AS t FROM documents) WHERE len(t) > 0),
vocab AS (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) + 3 AS token_id
  FROM (SELECT token, count(*) AS cnt FROM toks GROUP BY token) WHERE cnt >= 2)"""


def doc_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", X.words(F.col("text")).alias("t"))


@query("vocabulary", f"WITH {_VOCAB} SELECT token, cnt, token_id FROM vocab")
def vocabulary(spark, sf):
    return C.build_vocabulary(doc_tokens(spark, sf), "t")


@query("numericalize", f"""WITH {_VOCAB} SELECT doc_id, count(t.token) AS n, count(t.token) FILTER (v.token IS NULL) AS unknown,
coalesce(string_agg(CASE WHEN t.token IS NOT NULL THEN coalesce(token_id, 3)::VARCHAR END, ' ' ORDER BY pos), '') AS ids
FROM documents d LEFT JOIN toks t USING (doc_id) LEFT JOIN vocab v ON v.token = t.token GROUP BY doc_id""")
def numericalize(spark, sf):
    t = doc_tokens(spark, sf)
    ids = C.numericalize(t, "doc_id", "t", C.build_vocabulary(t, "t"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"),
                      F.size(F.filter("ids", lambda x: x == C.UNKNOWN)).cast("long").alias("unknown"),
                      F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))
