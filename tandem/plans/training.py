"""Registered queries over training tables and noising."""
from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions import arrays as A
from tandem.functions.hashing import state_sql, uniform_sql
from tandem.functions.text import words
from tandem.operators import batches as B
from tandem.operators import noise as N
from tandem.plans import views as V
from tandem.plans.registry import query, table
from tandem.scale import ranked

LANGS = ["de", "en", "es", "fr"]
_LANGS = ", ".join(f"'{x}'" for x in LANGS)
SIZE = 16


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "text")


def doc_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", words(F.col("text")).alias("t"))


_TOK = f"tok AS MATERIALIZED (SELECT doc_id, lang, {V.sql_words('text')} AS t FROM documents)"


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


# ---- data sets ------------------------------------------------------------

@query("epoch_shard", """WITH s AS (SELECT hash_shard AS shard, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (
  SELECT doc_id % 8 AS hash_shard, n_chars FROM documents) GROUP BY 1),
e AS (SELECT unnest(range(1, 13)) AS epoch)
SELECT epoch::INT AS epoch, shard, n, chars FROM e JOIN s ON shard = (epoch - 1) % 8""")
def epoch_shard(spark, sf):
    """Rows read in each of twelve epochs over eight shards; every row belongs to one shard."""
    d = table(spark, sf, "documents").select((F.col("doc_id") % 8).alias("shard"), "n_chars")
    shards = d.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    epochs = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda e: B.epoch_shard(8, e) == F.col("shard"))
    return shards.select(F.explode(epochs).alias("epoch"), "shard", "n", "chars")


@query("upsample_concat", """SELECT lang, n, chars FROM (SELECT lang, CASE WHEN lang = 'en' THEN 3 ELSE 1 END * count(*) AS n,
(CASE WHEN lang = 'en' THEN 3 ELSE 1 END * sum(n_chars))::BIGINT AS chars FROM documents GROUP BY lang)""")
def upsample_concat(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    mixed = B.upsample_concat(d.filter(F.col("lang") == "en"), [d.filter(F.col("lang") != "en")], 3)
    return mixed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("round_robin_zip", """WITH p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents),
n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
s AS (SELECT unnest(range((SELECT max(n) FROM n))) AS step)
SELECT s.step, p.lang, p.doc_id AS row FROM s, n JOIN p ON p.lang = n.lang WHERE p.pos = s.step % n.n""")
def round_robin_zip(spark, sf):
    return B.round_robin_zip(docs(spark, sf), "lang", LANGS, "doc_id")


_PROBS = """n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
w AS (SELECT lang, n, pow(n / (SELECT sum(n) FROM n), 0.7) AS w FROM n),
probs AS (SELECT lang, n, w / (SELECT sum(w) FROM w) AS p FROM w)"""


@query("sampling_probs", f"WITH {_PROBS} SELECT lang, n, round(p, 6) AS p FROM probs")
def sampling_probs(spark, sf):
    return B.sampling_probs(docs(spark, sf), "lang", 0.7).withColumn("p", F.round("p", 6))


@query("weighted_draw", f"""WITH {_PROBS}, r0 AS (SELECT lang, round(p, 4) AS p FROM probs), r AS (SELECT lang, p / (SELECT sum(p) FROM r0) AS p FROM r0),
c AS (SELECT lang, sum(p) OVER (ORDER BY lang) AS hi, row_number() OVER (ORDER BY lang DESC) = 1 AS last FROM r),
e AS (SELECT lang, CASE WHEN last THEN 2.0 ELSE hi END AS hi, coalesce(lag(hi) OVER (ORDER BY lang), 0) AS lo FROM c),
u AS (SELECT doc_id, {uniform_sql(11, "doc_id")} AS u FROM documents)
SELECT doc_id, lang AS drawn FROM u JOIN e ON u >= lo AND u < hi""")
def weighted_draw(spark, sf):
    probs = B.sampling_probs(docs(spark, sf), "lang", 0.7).withColumn("p", F.round("p", 4))
    return B.weighted_draw(docs(spark, sf).select("doc_id"), "doc_id", probs, "lang", LANGS, 11)


_POOL = "CASE WHEN doc_id % 3 = 0 THEN 'para' ELSE 'mono' END"
_POOLED = f"""pn AS (SELECT {_POOL} AS pool, lang, count(*) AS n FROM documents GROUP BY ALL),
pw AS (SELECT *, pow(n / sum(n) OVER (PARTITION BY pool), 0.7) AS w, count(*) OVER (PARTITION BY pool) AS k FROM pn),
pools AS (SELECT pool, lang, n, w / sum(w) OVER (PARTITION BY pool) AS p, 1 / k AS p_off FROM pw)"""


def _pooled(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, "para").otherwise("mono").alias("pool"))


@query("pool_probs", f"WITH {_POOLED} SELECT pool, lang, n, round(p, 6) AS p, round(p_off, 6) AS p_off FROM pools")
def pool_probs(spark, sf):
    """Two pools with shares of their own, weighted and with weighting off."""
    d = _pooled(spark, sf)
    off = B.pool_probs(d, "pool", "lang", -1).select("pool", "lang", F.round("p", 6).alias("p_off"))
    return B.pool_probs(d, "pool", "lang", 0.7).withColumn("p", F.round("p", 6)).join(off, ["pool", "lang"])


_RACE = f"""{_POOLED}, fixed AS (SELECT lang, round(p, 4) AS p, list_position([{_LANGS}], lang) - 1 AS no FROM pools WHERE pool = 'mono'),
race AS (SELECT doc_id, draw, lang, -ln(1 - {uniform_sql(17, "doc_id", "draw * 4 + no")}) / p AS arrival
  FROM documents, unnest(range(3)) d(draw), fixed)""".replace("documents, unnest(range(3)) d(draw), fixed", "(SELECT doc_id FROM documents) x, unnest(range(3)) d(draw), fixed")


def _races(spark, sf, replace):
    probs = B.pool_probs(_pooled(spark, sf), "pool", "lang", 0.7).filter("pool = 'mono'").withColumn("p", F.round("p", 4))
    return B.race_draws(docs(spark, sf).select("doc_id"), "doc_id", probs, "lang", LANGS, 3, 17, replace)


@query("draws_with_replacement", f"WITH {_RACE} SELECT doc_id, draw::INT AS draw, arg_min(lang, arrival) AS lang FROM race GROUP BY doc_id, draw")
def draws_with_replacement(spark, sf):
    return _races(spark, sf, True)


@query("draws_without_replacement", f"""WITH {_RACE}, o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY arrival) - 1 AS draw FROM race WHERE draw = 0)
SELECT doc_id, draw::INT AS draw, lang FROM o WHERE draw < 3""")
def draws_without_replacement(spark, sf):
    return _races(spark, sf, False)


_MIRROR = f"((({state_sql(23, 'r')} % n) - x) % n + n) % n"


@query("permuted_order", f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, pos, list_reduce(list_concat([pos], range(48)), lambda x, r: CASE WHEN {state_sql(24, "r", f"greatest(x, {_MIRROR})")} % 2 = 1
  THEN {_MIRROR} ELSE x END)::BIGINT AS permuted FROM p""")
def permuted_order(spark, sf):
    """Every document's place in a random order, from its position alone."""
    d = docs(spark, sf).select("doc_id")
    placed = ranked(B._id_blocks(d, "doc_id"), [], B.BLOCKS, ["doc_id"], "pos").select("doc_id", "pos")
    n = d.agg(F.count(F.lit(1))).scalar()
    return placed.withColumn("n", n).select("doc_id", "pos", B.permuted(F.col("pos"), F.col("n"), 23).alias("permuted"))


@query("other_lang", f"""SELECT doc_id, lang, list_filter([{_LANGS}], lambda x: x <> lang)[1 + {state_sql(5, "doc_id")} % 3] AS other FROM documents""")
def other_lang(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", B.other_lang(F.col("lang"), LANGS, 5, F.col("doc_id")).alias("other"))


@query("every_kth_sample", """SELECT lang, doc_id, pos FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
FROM documents) WHERE (pos + 1) % 10 = 0""")
def every_kth_sample(spark, sf):
    return B.every_kth(docs(spark, sf).select("lang", "doc_id"), "lang", "doc_id", 10)


# ---- batches --------------------------------------------------------------

def ordered_pairs(spark, sf, seed=3):
    """Conversation pairs with lengths, in batch order."""
    p = V.token_pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
                                        F.col("hyp").alias("src"), F.col("ref").alias("tgt"))
    p = p.withColumn("src_len", F.size("src")).withColumn("tgt_len", F.size("tgt"))
    return B.batches(B.batch_order(p, "pair_id", "src_len", "tgt_len", seed), SIZE)


_ORDER = f"""{V.SQL_PAIRS}, tp AS (SELECT conv_id * 1000 + turn AS pair_id, {V.sql_words("hyp")} AS src, {V.sql_words("ref")} AS tgt FROM pairs),
o AS (SELECT *, row_number() OVER (ORDER BY len(src), len(tgt), {uniform_sql(3, "pair_id")}, pair_id) - 1 AS position FROM tp),
b AS (SELECT *, position // {SIZE} AS batch_id FROM o)"""


@query("batch_order", f"WITH {_ORDER} SELECT pair_id, len(src)::INT AS src_len, len(tgt)::INT AS tgt_len, position, batch_id FROM b")
def batch_order(spark, sf):
    return ordered_pairs(spark, sf).select("pair_id", "src_len", "tgt_len", "position", "batch_id")


@query("batch_sort_desc", f"""WITH {_ORDER} SELECT batch_id, pair_id, (row_number() OVER (PARTITION BY batch_id ORDER BY len(src) DESC, position) - 1)::INT AS slot FROM b""")
def batch_sort_desc(spark, sf):
    return B.sort_in_batch(ordered_pairs(spark, sf), "src_len").select("batch_id", "pair_id", "slot")


def _sql_pad(x: str, w: str, left: bool) -> str:
    fill = f"list_transform(range({w} - len({x})), lambda i: '<pad>')"
    return f"list_concat({fill}, {x})" if left else f"list_concat({x}, {fill})"


@query("pad_batch", f"""WITH {_ORDER}, w AS (SELECT *, max(len(src)) OVER (PARTITION BY batch_id) AS w FROM b)
SELECT batch_id, pair_id, array_to_string({_sql_pad("src", "w", True)}, ' ') AS src FROM w""")
def pad_batch(spark, sf):
    p = B.pad_batch(ordered_pairs(spark, sf), "src", F.lit("<pad>"), True)
    return p.select("batch_id", "pair_id", F.array_join("src", " ").alias("src"))


_SHIFT = "list_concat(list_slice(tgt, len(tgt), len(tgt)), list_slice(tgt, 1, len(tgt) - 1))"


@query("batch_table", f"""WITH {_ORDER}, w AS (SELECT *, max(len(src)) OVER (PARTITION BY batch_id) AS sw, max(len(tgt)) OVER (PARTITION BY batch_id) AS tw FROM b)
SELECT batch_id, count(*) AS nsentences, sum(len(tgt))::BIGINT AS ntokens,
  string_agg(pair_id::VARCHAR, ' ' ORDER BY len(src) DESC, position) AS ids,
  string_agg(array_to_string({_sql_pad("src", "sw", True)}, ' '), '|' ORDER BY len(src) DESC, position) AS src_tokens,
  string_agg(array_to_string({_sql_pad("tgt", "tw", False)}, ' '), '|' ORDER BY len(src) DESC, position) AS target,
  string_agg(array_to_string({_sql_pad(_SHIFT, "tw", False)}, ' '), '|' ORDER BY len(src) DESC, position) AS prev_output_tokens
FROM w GROUP BY batch_id""")
def batch_table(spark, sf):
    t = B.batch_table(ordered_pairs(spark, sf), "pair_id", "src", "tgt", F.lit("<pad>"))

    def rows(c):
        return F.array_join(F.transform(c, lambda x: F.array_join(x, " ")), "|").alias(c)

    return t.select("batch_id", "nsentences", "ntokens", joined("ids").alias("ids"), rows("src_tokens"),
                    rows("target"), rows("prev_output_tokens"))


@query("length_buckets", f"""WITH {_TOK}, l AS (SELECT doc_id, len(t)::INT AS len FROM tok),
s AS (SELECT len, row_number() OVER (ORDER BY len) - 1 AS r, count(*) OVER () AS n FROM l),
q AS (SELECT DISTINCT len AS b FROM s, (SELECT unnest(range(1, 9)) AS i) WHERE r = (i * (n - 1)) // 8)
SELECT doc_id, len, (SELECT min(b) FROM q WHERE b >= len) AS bucket FROM l""")
def length_buckets(spark, sf):
    t = doc_tokens(spark, sf).select("doc_id", F.size("t").alias("len"))
    return B.length_buckets(t, "len", 8).select("doc_id", "len", "bucket")


@query("alignment_weights", f"""WITH {V.SQL_PAIRS}, t AS (SELECT conv_id, turn, len({V.sql_words("hyp")}) AS h, len({V.sql_words("ref")}) AS r FROM pairs),
a AS (SELECT conv_id, turn, unnest(range(h)) AS src, h, r FROM t WHERE h > 0 AND r > 0),
x AS (SELECT conv_id, turn, src::INT AS src, ((src * r // h) % 7)::INT AS tgt FROM a)
SELECT conv_id, turn, src, tgt, round(1.0 / count(*) OVER (PARTITION BY conv_id, turn, tgt), 6) AS weight FROM x""")
def alignment_weights(spark, sf):
    t = V.token_pairs(spark, sf).select(*V.PAIR, F.size("hyp").alias("h"), F.size("ref").alias("r"))
    a = t.filter((F.col("h") > 0) & (F.col("r") > 0)).select(
        *V.PAIR, F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("src"), "h", "r")
    a = a.select(*V.PAIR, "src", (F.floor(F.col("src") * F.col("r") / F.col("h")) % 7).cast("int").alias("tgt"))
    return B.alignment_weights(a, V.PAIR, "tgt").withColumn("weight", F.round("weight", 6))


# ---- tokens of a row ------------------------------------------------------

@query("special_tokens", f"""WITH {_TOK} SELECT doc_id, array_to_string(list_concat(list_concat(
list_slice(CASE WHEN t[len(t)] = 'the.' THEN list_slice(t, 1, len(t) - 1) ELSE t END, 1, 63), ['the.']), ['__' || lang || '__']), ' ') AS tokens FROM tok""")
def special_tokens(spark, sf):
    t = doc_tokens(spark, sf)
    framed = F.concat(A.frame(F.col("t"), 64, "the."), F.array(A.lang_tag(F.col("lang"))))
    return t.select("doc_id", F.array_join(framed, " ").alias("tokens"))


@query("truncate_eos", f"""WITH {_TOK} SELECT doc_id, array_to_string(CASE WHEN len(t) > 50 THEN list_concat(list_slice(t, 1, 49), ['</s>']) ELSE t END, ' ') AS tokens FROM tok""")
def truncate_eos(spark, sf):
    cut = A.truncate_with_end(F.col("t"), 50, F.lit("</s>"))
    return doc_tokens(spark, sf).select("doc_id", F.array_join(cut, " ").alias("tokens"))


@query("lang_tag", f"""WITH {_TOK} SELECT doc_id, '__' || lang || '__' AS tag, coalesce(list_filter(list_concat(t, ['__' || lang || '__']),
lambda x: list_contains(['__de__', '__en__', '__es__'], x))[1], '') AS found FROM tok""")
def lang_tag(spark, sf):
    t = doc_tokens(spark, sf)
    tagged = F.concat("t", F.array(A.lang_tag(F.col("lang"))))
    return t.select("doc_id", A.lang_tag(F.col("lang")).alias("tag"),
                    A.first_lang_tag(tagged, ["de", "en", "es"]).alias("found"))


@query("concat_pair", f"""WITH {V.SQL_PAIRS}, t AS (SELECT conv_id, turn, list_concat(list_concat(['</s>'], {V.sql_words("hyp")}), ['</s>']) AS a,
  list_concat(list_concat(['</s>'], {V.sql_words("ref")}), ['</s>']) AS b FROM pairs)
SELECT conv_id, turn, array_to_string(list_concat(a, b), ' ') AS tokens,
  array_to_string(list_concat(range(len(a)), range(len(b))), ' ') AS positions,
  array_to_string(list_concat(list_transform(a, lambda x: 0), list_transform(b, lambda x: 1)), ' ') AS langs,
  array_to_string(list_concat(list_slice(a, 1, len(a) - 1), b), ' ') AS glued FROM t""")
def concat_pair(spark, sf):
    eos = F.array(F.lit("</s>"))
    p = V.token_pairs(spark, sf).select(*V.PAIR, F.concat(eos, "hyp", eos).alias("a"), F.concat(eos, "ref", eos).alias("b"))
    x = p.select(*V.PAIR, B.concat_pair(F.col("a"), F.col("b"), F.lit(0), F.lit(1), True).alias("x"),
                 B.concat_pair(F.col("a"), F.col("b"), F.lit(0), F.lit(1), False)["tokens"].alias("g"))
    return x.select(*V.PAIR, F.array_join("x.tokens", " ").alias("tokens"), joined(F.col("x.positions")).alias("positions"),
                    joined(F.col("x.langs")).alias("langs"), F.array_join("g", " ").alias("glued"))


SCHEDULE = "0:1,3000:0.25,8000:0"


@query("schedule_value", """SELECT event_id, round(CASE WHEN event_id < 3000 THEN 1 - event_id * 0.75 / 3000
WHEN event_id < 8000 THEN 0.25 - (event_id - 3000) * 0.25 / 5000 ELSE 0 END::DOUBLE, 6) AS value FROM events""")
def schedule_value(spark, sf):
    value = B.schedule(F.col("event_id"), B.parse_schedule(SCHEDULE))
    return table(spark, sf, "events").select("event_id", F.round(value, 6).alias("value"))


# ---- noise ----------------------------------------------------------------

_I = "(i - 1)"


@query("noise_shuffle", f"""WITH {_TOK} SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(t, lambda x, i:
{{'s': CASE WHEN i = 1 THEN -1.0::DOUBLE ELSE {_I} + {uniform_sql(1, "doc_id", _I)} * 3.0 END, 'i': i, 't': x}})), lambda s: s.t), ' ') AS tokens FROM tok""")
def noise_shuffle(spark, sf):
    t = doc_tokens(spark, sf)
    return t.select("doc_id", F.array_join(A.local_shuffle(F.col("t"), 3.0, 1, F.col("doc_id")), " ").alias("tokens"))


@query("noise_dropout", f"""WITH {_TOK}, k AS (SELECT doc_id, t, list_filter(t, lambda x, i: i = 1 OR {uniform_sql(2, "doc_id", _I)} >= 0.3) AS k FROM tok)
SELECT doc_id, array_to_string(CASE WHEN len(k) = 1 AND len(t) > 1 THEN list_concat(k, [t[2 + floor({uniform_sql(3, "doc_id")} * (len(t) - 1))::INT]]) ELSE k END, ' ') AS tokens FROM k""")
def noise_dropout(spark, sf):
    t = doc_tokens(spark, sf)
    return t.select("doc_id", F.array_join(A.drop_tokens(F.col("t"), 0.3, 2, F.col("doc_id")), " ").alias("tokens"))


@query("noise_blank", f"""WITH {_TOK} SELECT doc_id, array_to_string(list_transform(t, lambda x, i: CASE WHEN i = 1 OR {uniform_sql(4, "doc_id", _I)} >= 0.2
THEN x ELSE '<mask>' END), ' ') AS tokens FROM tok""")
def noise_blank(spark, sf):
    t = doc_tokens(spark, sf)
    return t.select("doc_id", F.array_join(A.blank_tokens(F.col("t"), 0.2, "<mask>", 4, F.col("doc_id")), " ").alias("tokens"))


_SPANS = N.span_sql("marked", "doc_id", seed=9)


@query("noise_span", f"""WITH {_TOK}, marked AS (SELECT doc_id, list_concat([2::BIGINT], list_transform(t, lambda w: (length(w) + 100)::BIGINT), [2::BIGINT]) AS ids
FROM tok), {_SPANS} SELECT * FROM masked""")
def noise_span(spark, sf):
    """Word lengths as stand-in ids between end marks."""
    ids = doc_tokens(spark, sf).select("doc_id", F.concat(F.array(F.lit(2).cast("bigint")), F.transform(
        "t", lambda w: (F.length(w) + 100).cast("bigint")), F.array(F.lit(2).cast("bigint"))).alias("ids"))
    return N.mask_spans(ids, "doc_id", "ids", seed=9).select("doc_id", F.size("ids").alias("n"), joined("ids").alias("ids"))
