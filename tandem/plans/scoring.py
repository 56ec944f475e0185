"""Registered scoring queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions.text import nl_tokens, words
from tandem.operators import corpus as C
from tandem.operators import ngrams as G
from tandem.operators import scores as S
from tandem.plans import views as V
from tandem.plans.registry import query, table
from tandem.scale import placed
from tandem.plans.textsql import sql_nl_tokens

KEYWORDS = ["la", "the", "le", "de", "and", "un", "der", "die", "of", "el"]
PAIR = V.PAIR


def r6(c, name):
    return F.round(c, 6).alias(name)


def _copies_tokens(spark, sf):
    return V.copies(spark, sf).select("doc_id", words(F.col("hyp")).alias("hyp"), words(F.col("ref")).alias("ref"))


@query("exact_match", f"""WITH {V.SQL_COPIES}
SELECT count(*) AS pairs, sum(CASE WHEN hyp = ref THEN 1 ELSE 0 END)::BIGINT AS equal_pairs,
  round(100.0 * sum(CASE WHEN hyp = ref THEN 1 ELSE 0 END) / count(*), 6) AS em FROM copies""")
def exact_match(spark, sf):
    c = V.copies(spark, sf)
    same = F.col("hyp") == F.col("ref")
    return c.agg(F.count(F.lit(1)).alias("pairs"), F.sum(same.cast("long")).alias("equal_pairs"),
                 r6(S.exact_match(F.col("hyp"), F.col("ref")), "em"))


@query("ngram_counts", f"""WITH {V.SQL_PAIRS}, {V.sql_stats("pairs", PAIR)}
SELECT n, count(*) AS grams, sum(ch)::BIGINT AS occurrences, max(ch)::BIGINT AS most
FROM bags WHERE ch > 0 GROUP BY n""")
def ngram_counts(spark, sf):
    return G.ngram_counts(V.token_pairs(spark, sf), PAIR, "hyp").groupBy("n").agg(
        F.count(F.lit(1)).alias("grams"), F.sum("cnt").alias("occurrences"), F.max("cnt").alias("most"))


def _padded_sql() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT conv_id, turn, {n} AS n, unnest(list_transform(range(1, len(x) - {n - 2}),
        lambda i: array_to_string(list_slice(x, i, i + {n - 1}), ' '))) AS gram FROM (
        SELECT conv_id, turn, list_concat(list_concat([{", ".join(["'<s>'"] * (n - 1))}]::VARCHAR[], t),
        [{", ".join(["'</s>'"] * (n - 1))}]::VARCHAR[]) AS x FROM t) WHERE len(x) >= {n}""" for n in (1, 2, 3))
    return f"""WITH {V.SQL_PAIRS}, t AS (SELECT conv_id, turn, {V.sql_words("hyp")} AS t FROM pairs),
g AS ({parts})
SELECT n, gram, count(*) AS cnt FROM g GROUP BY n, gram"""


@query("ngram_padded", _padded_sql())
def ngram_padded(spark, sf):
    bags = G.ngram_counts(V.token_pairs(spark, sf), PAIR, "hyp", 3, "<s>", "</s>")
    return bags.groupBy("n", "gram").agg(F.sum("cnt").alias("cnt"))


@query("bleu_smoothed", f"""WITH {V.SQL_PAIRS}, {V.sql_stats("pairs", PAIR)}, {V.sql_corpus()}
SELECT pairs::BIGINT AS pairs, hyp_len::BIGINT AS hyp_len, ref_len::BIGINT AS ref_len, m1::BIGINT AS m1,
  m2::BIGINT AS m2, m3::BIGINT AS m3, m4::BIGINT AS m4, round(100 * {V.sql_smoothed()}, 6) AS bleu FROM corpus""")
def bleu_smoothed(spark, sf):
    c = S.corpus_stats(G.match_stats(V.token_pairs(spark, sf), PAIR))
    return c.select("pairs", "hyp_len", "ref_len", "m1", "m2", "m3", "m4", r6(100 * S.bleu_smoothed(), "bleu"))


@query("bleu_corpus", f"""WITH {V.SQL_COPIES}, {V.sql_stats("copies", ["doc_id"])}, {V.sql_corpus()}
SELECT pairs::BIGINT AS pairs, round({V.sql_epsilon()}, 6) AS bleu FROM corpus""")
def bleu_corpus(spark, sf):
    c = S.corpus_stats(G.match_stats(_copies_tokens(spark, sf), ["doc_id"]))
    return c.select("pairs", r6(S.bleu_epsilon(), "bleu"))


def _multi_sql(source: str = V.SQL_MULTI_REF, tie: str = "len(ref)") -> str:
    grams = " UNION ALL ".join(
        f"""SELECT conv_id, turn, {no} AS ref_no, {n} AS n, unnest(list_transform(range(1, greatest(len({c}) - {n - 2}, 1)),
        lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' '))) AS g FROM {src}"""
        for n in (1, 2, 3, 4) for src, c, no in (("hyps", "hyp", "-1"), ("refs", "ref", "ref_no")))
    return f"""{source}, g AS ({grams}),
cnts AS (SELECT conv_id, turn, ref_no, n, g, count(*) AS c FROM g GROUP BY ALL),
bags AS (SELECT conv_id, turn, n, g, coalesce(max(c) FILTER (ref_no < 0), 0) AS ch,
  coalesce(max(c) FILTER (ref_no >= 0), 0) AS cr FROM cnts GROUP BY conv_id, turn, n, g),
hits AS (SELECT conv_id, turn, {", ".join(f"sum(CASE WHEN n = {n} THEN least(ch, cr) ELSE 0 END)::BIGINT AS m{n}"
                                    for n in (1, 2, 3, 4))} FROM bags GROUP BY conv_id, turn),
lens AS (SELECT conv_id, turn, len(hyp) AS hyp_len, len(ref) AS rl,
  row_number() OVER (PARTITION BY conv_id, turn ORDER BY abs(len(ref) - len(hyp)), {tie}) AS k
  FROM refs JOIN hyps USING (conv_id, turn)),
stats AS (SELECT l.conv_id, l.turn, l.hyp_len, l.rl AS ref_len, {", ".join(f"coalesce(m{n}, 0) AS m{n}" for n in (1, 2, 3, 4))},
  0 AS k1, 0 AS ref_kw FROM lens l LEFT JOIN hits USING (conv_id, turn) WHERE k = 1)"""


@query("bleu_multi_ref", f"""WITH {_multi_sql()}, {V.sql_corpus()}
SELECT pairs::BIGINT AS pairs, ref_len::BIGINT AS ref_len, round({V.sql_epsilon()}, 6) AS bleu FROM corpus""")
def bleu_multi_ref(spark, sf):
    hyps, refs = V.multi_ref(spark, sf)
    c = S.corpus_stats(G.multi_ref_stats(hyps, refs, PAIR))
    return c.select("pairs", "ref_len", r6(S.bleu_epsilon(), "bleu"))


@query("bleu_sentence", f"""WITH {V.SQL_PAIRS}, {V.sql_stats("pairs", PAIR, 5)},
{V.sql_corpus(5, "conv_id, turn")}
SELECT conv_id, turn, round({V.sql_epsilon()}, 6) AS bleu4, round({V.sql_epsilon((0.2,) * 5)}, 6) AS bleu5
FROM corpus""")
def bleu_sentence(spark, sf):
    s = S.sentence_stats(G.match_stats(V.token_pairs(spark, sf), PAIR, max_n=5), PAIR, 5)
    return s.select(*PAIR, r6(S.bleu_epsilon(), "bleu4"), r6(S.bleu_epsilon((0.2,) * 5), "bleu5"))


def _smoothing_sql() -> str:
    exprs = {0: [f"(CASE WHEN m{n} = 0 THEN 2.2250738585072014e-308 ELSE m{n} / q{n} END)" for n in range(1, 5)],
             1: [f"((CASE WHEN m{n} = 0 THEN 0.1 ELSE m{n} END) / q{n})" for n in range(1, 5)],
             2: [f"((m{n} + 1) / (q{n} + 1))" for n in range(1, 5)]}
    zeros = [" + ".join(["1"] + [f"(m{j} = 0)::INT" for j in range(1, n)]) for n in range(1, 5)]
    exprs[3] = [f"(CASE WHEN m{n} = 0 THEN 1 / (pow(2, {zeros[n - 1]}) * q{n}) ELSE m{n} / q{n} END)"
                for n in range(1, 5)]
    exprs[4] = [f"(CASE WHEN m{n} = 0 THEN ({n - 1} + 5 / ln(hyp_len)) / q{n} ELSE m{n} / q{n} END)"
                for n in range(1, 5)]
    for method, base in ((5, [f"(m{n} / q{n})" for n in range(1, 5)]), (7, exprs[4])):
        nxt, left, out = base[1:] + ["(m5 / q5)"], f"({base[0]} + 1)", []
        for i in range(4):
            left = f"(({left} + {base[i]} + {nxt[i]}) / 3)"
            out.append(left)
        exprs[method] = out
    p3 = "((m3 + 5 * (m2 / q2) * (m2 / q2) / (m1 / q1)) / (p3 + 5))"
    p4 = f"((m4 + 5 * {p3} * {p3} / (m2 / q2)) / (p4 + 5))"
    exprs[6] = ["(m1 / q1)", "(m2 / q2)", p3, p4]
    cols = []
    for m in range(8):
        guard = "WHEN m3 = 0 THEN NULL " if m == 6 else ""
        guard += "WHEN hyp_len = 1 AND least(m1, m2, m3, m4) = 0 THEN NULL " if m in (4, 7) else ""
        logs = " + ".join(f"ln({e})" for e in exprs[m])
        cols.append(f"round(CASE WHEN m1 = 0 THEN 0.0 {guard}ELSE {V.sql_penalty()} * exp(({logs}) / 4) END, 6) AS s{m}")
    return ", ".join(cols)


@query("bleu_smoothing_methods", f"""WITH {V.SQL_PAIRS}, {V.sql_stats("pairs", PAIR, 5)},
{V.sql_corpus(5, "conv_id, turn")} SELECT conv_id, turn, {_smoothing_sql()} FROM corpus""")
def bleu_smoothing_methods(spark, sf):
    s = S.sentence_stats(G.match_stats(V.token_pairs(spark, sf), PAIR, max_n=5), PAIR, 5)
    return s.select(*PAIR, *[r6(S.bleu_with_smoothing(m), f"s{m}") for m in range(8)])


@query("bleu_weighted_recall", f"""WITH {V.SQL_PAIRS}, {V.sql_stats("pairs", PAIR, keywords=KEYWORDS)}, {V.sql_corpus()}
SELECT pairs::BIGINT AS pairs, round({V.sql_recall()}, 6) AS bleu FROM corpus""")
def bleu_weighted_recall(spark, sf):
    c = S.corpus_stats(G.match_stats(V.token_pairs(spark, sf), PAIR, keywords=KEYWORDS), weighted=True)
    return c.select("pairs", r6(S.bleu_recall(), "bleu"))


def _recall_multi_sql() -> str:
    sums = ", ".join(f"sum(m{n})::DOUBLE AS m{n}, sum(greatest(ref_len - {n - 1}, 1))::DOUBLE AS r{n}" for n in (2, 3, 4))
    tops = ", ".join(f"sum(m{n}) AS m{n}, sum(r{n}) AS r{n}" for n in (2, 3, 4))
    return f"""WITH {V.SQL_MULTI_REF}, rows AS (SELECT conv_id, turn, ref_no, array_to_string(hyp, ' ') AS hyp,
  array_to_string(ref, ' ') AS ref FROM refs JOIN hyps USING (conv_id, turn)),
{V.sql_stats("rows", [*PAIR, "ref_no"], keywords=KEYWORDS)},
pp AS (SELECT conv_id, turn, max(hyp_len) AS hyp_len, sum(0.2 * m1 + 0.8 * k1)::DOUBLE AS wm1,
  sum(greatest(0.2 * ref_len + 0.8 * ref_kw, 1))::DOUBLE AS wr1, {sums} FROM stats GROUP BY conv_id, turn),
corpus AS (SELECT count(*)::DOUBLE AS pairs, sum(hyp_len)::DOUBLE AS hyp_len, sum(wm1) AS wm1, sum(wr1) AS wr1, {tops} FROM pp)
SELECT pairs::BIGINT AS pairs, hyp_len::BIGINT AS hyp_len, round({V.sql_recall()}, 6) AS bleu FROM corpus"""


@query("bleu_recall_multi_ref", _recall_multi_sql())
def bleu_recall_multi_ref(spark, sf):
    hyps, refs = V.multi_ref(spark, sf)
    per_ref = G.match_stats(refs.join(hyps, PAIR), [*PAIR, "ref_no"], keywords=KEYWORDS)
    return S.recall_stats(per_ref, PAIR).select("pairs", "hyp_len", r6(S.bleu_recall(), "bleu"))


_NL = " + ".join(f"ln(m{n}::DOUBLE + {a} + 2.2250738585072014e-308) - "
                 f"ln(greatest(hyp_len - {n - 1}, 0)::DOUBLE + {a} + 2.2250738585072014e-308)"
                 for n, a in ((1, 0), (2, 1), (3, 1), (4, 1)))
_NL1 = ", ".join(f"avg(CASE WHEN hyp_len < {n} THEN 0.0 ELSE exp(ln(m{n}::DOUBLE + 2.2250738585072014e-308) "
                 f"- ln(hyp_len - {n - 1})) END) AS b{n}" for n in range(1, 5))


@query("bleu_nl_mean", f"""WITH {V.SQL_PAIRS}, {V.sql_stats("pairs", PAIR, tok=sql_nl_tokens)},
a AS (SELECT count(*) AS pairs, avg(exp(({_NL}) / 4 + least(0, 1 - (ref_len + 1) / (hyp_len + 1)))) AS b, {_NL1}
FROM stats)
SELECT pairs, round(100 * b, 2) AS bleu, {", ".join(f"round(100 * b{n}, 2) AS bleu_{n}" for n in range(1, 5))} FROM a""")
def bleu_nl_mean(spark, sf):
    p = V.pairs(spark, sf).select(*PAIR, nl_tokens(F.col("hyp")).alias("hyp"), nl_tokens(F.col("ref")).alias("ref"))
    per_pair = S.sentence_stats(G.match_stats(p, PAIR), PAIR).select(*S.nl_scores())
    names = ["bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4"]
    return per_pair.agg(F.count(F.lit(1)).alias("pairs"), *[F.round(100 * F.avg(n), 2).alias(n) for n in names])


_ONE_SIDED = f"""{V._SQL_ANSWERS},
refs AS (SELECT conv_id, turn, ref_no, {sql_nl_tokens("ref")} AS ref FROM answers WHERE conv_id % 5 <> 0),
hyps AS (SELECT conv_id, turn, {sql_nl_tokens("text")} AS hyp FROM conversations WHERE role = 'user' AND conv_id % 7 <> 0)"""


@query("bleu_nl_multi_ref", f"""WITH {_multi_sql(_ONE_SIDED, "ref_no")},
a AS (SELECT count(*) AS scored, avg(exp(({_NL}) / 4 + least(0, 1 - (ref_len + 1) / (hyp_len + 1)))) AS b, {_NL1} FROM stats),
ids AS (SELECT conv_id, turn, max(h) AS h, max(r) AS r FROM (SELECT conv_id, turn, 1 AS h, 0 AS r FROM hyps
  UNION ALL SELECT conv_id, turn, 0, 1 FROM refs) GROUP BY conv_id, turn)
SELECT scored, (SELECT count(*) FROM ids WHERE r = 0) AS only_hyp, (SELECT count(*) FROM ids WHERE h = 0) AS only_ref,
  round(100 * b, 2) AS bleu, {", ".join(f"round(100 * b{n}, 2) AS bleu_{n}" for n in range(1, 5))} FROM a""")
def bleu_nl_multi_ref(spark, sf):
    """Several references, ids that one side lacks, and the reference of the closest length, the first of equally close ones."""
    refs = V.answers(spark, sf).filter("conv_id % 5 <> 0").select(*PAIR, "ref_no", nl_tokens(F.col("ref")).alias("ref"))
    hyps = table(spark, sf, "conversations").filter("role = 'user' and conv_id % 7 <> 0").select(
        *PAIR, nl_tokens(F.col("text")).alias("hyp"))
    scores = S.sentence_stats(G.multi_ref_stats(hyps, refs, PAIR, ref_len="first"), PAIR).select(*S.nl_scores())
    names = ["bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4"]
    means = scores.agg(*[F.round(100 * F.avg(n), 2).alias(n) for n in names])
    both = C.coverage(hyps, refs, PAIR).unionByName(means, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in ["scored", "only_hyp", "only_ref", *names]])


@query("bleu_moses", f"""WITH {V.SQL_COPIES}, {V.sql_stats("copies", ["doc_id"], h="lower(hyp)", r="lower(ref)")},
{V.sql_corpus()} SELECT pairs::BIGINT AS pairs, round({V.sql_plain()}, 6) AS bleu FROM corpus""")
def bleu_moses(spark, sf):
    c = V.copies(spark, sf).select("doc_id", words(F.lower("hyp")).alias("hyp"), words(F.lower("ref")).alias("ref"))
    return S.corpus_stats(G.match_stats(c, ["doc_id"])).select("pairs", r6(S.bleu_plain(), "bleu"))


def _exp_sql() -> str:
    seen = [" + ".join(f"(m{j} = 0)::INT" for j in range(1, n + 1)) for n in range(1, 5)]
    logs = " + ".join(f"ln(CASE WHEN m{n} = 0 THEN 100 / (pow(2, {seen[n - 1]}) * p{n}) ELSE 100 * m{n} / p{n} END)"
                      for n in range(1, 5))
    return (f"(CASE WHEN p4 = 0 THEN 0.0 ELSE exp(({logs}) / 4) * "
            "(CASE WHEN hyp_len >= ref_len THEN 1.0 ELSE exp(1 - ref_len / hyp_len) END) END)")


@query("bleu_rollup", f"""WITH {V.SQL_PAIRS}, {V.sql_stats("pairs", PAIR)},
tagged AS (SELECT *, 'turn' || turn AS lang_pair, conv_id % 8 AS batch FROM stats),
corpus AS (SELECT lang_pair, batch, count(*)::DOUBLE AS pairs, sum(hyp_len)::DOUBLE AS hyp_len,
  sum(ref_len)::DOUBLE AS ref_len, {", ".join(f"sum(m{n})::DOUBLE AS m{n}, sum(greatest(hyp_len - {n - 1}, 0))::DOUBLE AS p{n}" for n in range(1, 5))}
  FROM tagged GROUP BY ROLLUP (lang_pair, batch))
SELECT coalesce(lang_pair, 'all') AS lang_pair, coalesce(batch, -1)::BIGINT AS batch, pairs::BIGINT AS pairs,
  m1::BIGINT AS m1, p1::BIGINT AS p1, round({_exp_sql()}, 6) AS bleu FROM corpus""")
def bleu_rollup(spark, sf):
    s = S.sentence_stats(G.match_stats(V.token_pairs(spark, sf), PAIR), PAIR)
    tagged = s.withColumn("lang_pair", F.concat(F.lit("turn"), "turn")).withColumn("batch", F.col("conv_id") % 8)
    sums = [F.sum(c).alias(c) for c in ["hyp_len", "ref_len", *[f"{x}{n}" for n in range(1, 5) for x in "mp"]]]
    c = tagged.rollup("lang_pair", "batch").agg(F.count(F.lit(1)).alias("pairs"), *sums)
    return c.select(F.coalesce("lang_pair", F.lit("all")).alias("lang_pair"),
                    F.coalesce("batch", F.lit(-1).cast("long")).alias("batch"), "pairs", "m1", "p1",
                    r6(S.bleu_exponential(), "bleu"))


# ---- subtrees and edges ---------------------------------------------------

def subtree_items(p, keys=PAIR):
    """Tree shapes of both texts of a pair: word lengths of neighbours, depth in the line.

    A pair is placed by its keys before its rows are made, and stays there for its sums.
    """
    sides = placed(p, keys).select(*keys, F.inline(F.array(F.struct(F.lit("hyp").alias("side"), F.col("hyp").alias("text")),
                                             F.struct(F.lit("ref").alias("side"), F.col("ref").alias("text")))))
    t = sides.select(*keys, "side", words(F.col("text")).alias("t"))
    shape = F.transform(F.col("t"), lambda w, i: F.struct(F.concat(
        F.lit("("), F.length(w), F.lit(" "), F.coalesce(F.length(F.get(F.col("t"), i + 1)), F.lit(0)),
        F.lit(")")).alias("sexp"), (i % 7 + 1).alias("depth")))
    return t.select(*keys, "side", F.inline_outer(shape)).filter(F.col("sexp").isNotNull())


def _by(by: str) -> tuple[str, str]:
    return (f"{by}, ", f" GROUP BY {by}") if by else ("", "")


def trees_sql(src: str = "pairs", keys: str = "conv_id, turn", by: str = "") -> str:
    head, tail = _by(by)
    return f"""sides AS (SELECT {keys}, 'hyp' AS side, {V.sql_words("hyp")} AS t FROM {src}
  UNION ALL SELECT {keys}, 'ref', {V.sql_words("ref")} FROM {src}),
words AS (SELECT {keys}, side, unnest(t) AS w, unnest(range(len(t))) AS i,
  unnest(list_concat(list_slice(t, 2, len(t)), ['']))  AS nx FROM sides WHERE len(t) > 0),
trees AS (SELECT {keys}, side, '(' || length(w) || ' ' || length(nx) || ')' AS sexp FROM words),
treebag AS (SELECT {keys}, sexp, count(*) FILTER (side = 'hyp') AS h, count(*) FILTER (side = 'ref') AS r
  FROM trees GROUP BY ALL),
treesum AS (SELECT {head}sum(CASE WHEN h > 0 THEN r ELSE 0 END)::BIGINT AS matched, sum(r)::BIGINT AS total
  FROM treebag{tail})"""


_TREES = trees_sql()


@query("subtree_overlap", f"""WITH {V.SQL_PAIRS}, {_TREES}
SELECT matched, total, round(matched / total, 6) AS score FROM treesum""")
def subtree_overlap(spark, sf):
    o = S.overlap(subtree_items(V.pairs(spark, sf)), PAIR, ["sexp"], membership=True)
    return o.select("matched", "total", r6(S.overlap_score(), "score"))


def edge_items(p, keys=PAIR):
    """Word-level edges: a word ending in a mark is copied from its neighbour, any other computed from two."""
    sides = placed(p, keys).select(*keys, F.inline(F.array(F.struct(F.lit("hyp").alias("side"), F.col("hyp").alias("text")),
                                             F.struct(F.lit("ref").alias("side"), F.col("ref").alias("text")))))
    t = sides.select(*keys, "side", words(F.lower("text")).alias("t"))

    def edge(w, i):
        copied = F.rlike(w, F.lit("[.,]$"))
        near = F.when(i >= 1, F.array(F.get(F.col("t"), i - 1))).otherwise(F.array().cast("array<string>"))
        far = F.when((i >= 2) & ~copied, F.array(F.get(F.col("t"), i - 2))).otherwise(F.array().cast("array<string>"))
        at = F.when(i >= 1, F.array(i - 1)).otherwise(F.array().cast("array<int>"))
        at2 = F.when((i >= 2) & ~copied, F.array(i - 2)).otherwise(F.array().cast("array<int>"))
        return F.struct(i.alias("pos"), F.regexp_replace(w, "[.,]+$", "").alias("var"),
                        F.when(copied, "comesFrom").otherwise("computedFrom").alias("rel"),
                        F.transform(F.concat(far, near), lambda x: F.regexp_replace(x, "[.,]+$", "")).alias("parents"),
                        F.concat(at2, at).alias("parent_pos"))

    return t.select(*keys, "side", F.inline_outer(F.transform(F.col("t"), edge))).filter(F.col("pos").isNotNull())


def edges_sql(src: str = "pairs", keys: str = "conv_id, turn") -> str:
    return f"""esides AS (SELECT {keys}, 'hyp' AS side, {V.sql_words("lower(hyp)")} AS t FROM {src}
  UNION ALL SELECT {keys}, 'ref', {V.sql_words("lower(ref)")} FROM {src}),
ewords AS (SELECT {keys}, side, unnest(t) AS w, unnest(range(len(t)))::INT AS pos,
  unnest(list_concat([''], list_slice(t, 1, len(t) - 1))) AS p1,
  unnest(list_slice(list_concat(['', ''], t), 1, len(t))) AS p2 FROM esides WHERE len(t) > 0),
edges AS (SELECT {keys}, side, pos, regexp_replace(w, '[.,]+$', '') AS var,
  CASE WHEN regexp_matches(w, '[.,]$') THEN 'comesFrom' ELSE 'computedFrom' END AS rel,
  CASE WHEN pos = 0 THEN ''
       WHEN pos = 1 OR regexp_matches(w, '[.,]$') THEN regexp_replace(p1, '[.,]+$', '')
       ELSE regexp_replace(p2, '[.,]+$', '') || ' ' || regexp_replace(p1, '[.,]+$', '') END AS parents
  FROM ewords)"""


def edge_sums_sql(src: str = "pairs", keys: str = "conv_id, turn", by: str = "") -> str:
    head, tail = _by(by)
    return edges_sql(src, keys) + f""",
edgebag AS (SELECT {keys}, var, rel, parents, count(*) FILTER (side = 'hyp') AS h,
  count(*) FILTER (side = 'ref') AS r FROM edges GROUP BY ALL),
edgesum AS (SELECT {head}sum(least(h, r))::BIGINT AS matched, sum(r)::BIGINT AS total FROM edgebag{tail})"""


SQL_EDGES, _EDGESUM = edges_sql(), edge_sums_sql()


@query("edge_bag_overlap", f"""WITH {V.SQL_PAIRS}, {_EDGESUM}
SELECT matched, total, round(CASE WHEN total = 0 THEN 1.0 ELSE matched / total END, 6) AS score FROM edgesum""")
def edge_bag_overlap(spark, sf):
    o = S.overlap(edge_items(V.pairs(spark, sf)), PAIR, ["var", "rel", "parents"])
    return o.select("matched", "total", r6(S.overlap_score(1.0), "score"))


TEXT_METRICS = {"ngram": S.bleu_epsilon, "weighted_ngram": S.bleu_recall}
QUARTERS = {m: 0.25 for m in ("ngram", "weighted_ngram", "syntax", "dataflow")}


def component_scores(spark, sf, **more):
    """The four components, and any further text scores, as a tidy table; each branch ends in one row."""
    stats = G.match_stats(V.token_pairs(spark, sf), PAIR, keywords=KEYWORDS)
    texts = {m: f() for m, f in TEXT_METRICS.items()} | more
    text = S.tidy(S.corpus_stats(stats, weighted=True).select(*[c.alias(m) for m, c in texts.items()]), [], list(texts))
    tree = S.overlap(subtree_items(V.pairs(spark, sf)), PAIR, ["sexp"], membership=True).select(
        F.lit("syntax").alias("metric"), S.overlap_score().alias("value"))
    flow = S.overlap(edge_items(V.pairs(spark, sf)), PAIR, ["var", "rel", "parents"]).select(
        F.lit("dataflow").alias("metric"), S.overlap_score(1.0).alias("value"))
    return text.unionByName(tree).unionByName(flow)


_COMPONENTS = f"""{V.SQL_PAIRS}, {V.sql_stats("pairs", PAIR, keywords=KEYWORDS)}, {V.sql_corpus()}, {_TREES}, {_EDGESUM}"""


@query("composite_score", f"""WITH {_COMPONENTS}
SELECT round(0.25 * {V.sql_epsilon()} + 0.25 * {V.sql_recall()}
  + 0.25 * (SELECT matched / total FROM treesum) + 0.25 * (SELECT matched / total FROM edgesum), 6) AS composite
FROM corpus""")
def composite_score(spark, sf):
    c = S.composite(component_scores(spark, sf), QUARTERS)
    return c.select(r6(F.col("composite"), "composite"))


BEAM = [*PAIR, "beam"]


def beam_metrics(spark, sf):
    """All metrics of each beam, tidy. MOSES is that of the first beam only, as reports have it."""
    b = V.beams(spark, sf)
    t = b.select(*BEAM, words(F.col("hyp")).alias("hyp"), words(F.col("ref")).alias("ref"))
    stats = G.match_stats(t, BEAM, keywords=KEYWORDS)
    scored = S.corpus_stats(stats, ["beam"], weighted=True).select(
        "beam", (100 * S.bleu_smoothed()).alias("BLEU"), (100 * S.bleu_epsilon()).alias("ngram"),
        (100 * S.bleu_recall()).alias("weighted_ngram"), F.when(F.col("beam") == 0, S.bleu_plain()).alias("MOSES"))
    em = b.groupBy("beam").agg(S.exact_match(F.col("hyp"), F.col("ref")).alias("EM"))
    tree = S.overlap(subtree_items(b, BEAM), BEAM, ["sexp"], ["beam"], membership=True).select(
        "beam", (100 * S.overlap_score()).alias("syntax"))
    flow = S.overlap(edge_items(b, BEAM), BEAM, ["var", "rel", "parents"], ["beam"]).select(
        "beam", (100 * S.overlap_score(1.0)).alias("dataflow"))
    wide = scored.join(em, "beam").join(tree, "beam").join(flow, "beam")
    whole = sum(w * F.col(m) for m, w in QUARTERS.items())
    return S.tidy(wide.withColumn("composite", whole), ["beam"], ["EM", "BLEU", "MOSES", *QUARTERS, "composite"])


_BEAM_METRICS = f"""{V.SQL_BEAMS}, {V.sql_stats("beams", BEAM, keywords=KEYWORDS)}, {V.sql_corpus(4, "beam")},
{trees_sql("beams", "conv_id, turn, beam", "beam")}, {edge_sums_sql("beams", "conv_id, turn, beam", "beam")},
em AS (SELECT beam, 100.0 * sum(CASE WHEN hyp = ref THEN 1 ELSE 0 END) / count(*) AS em FROM beams GROUP BY beam),
wide AS (SELECT beam, em, 100 * {V.sql_smoothed()} AS bleu, 100 * {V.sql_epsilon()} AS ng, 100 * {V.sql_recall()} AS wn,
  CASE WHEN beam = 0 THEN {V.sql_plain()} END AS mo, 100 * (SELECT matched / total FROM treesum t WHERE t.beam = corpus.beam) AS tree,
  100 * (SELECT matched / total FROM edgesum e WHERE e.beam = corpus.beam) AS flow FROM corpus JOIN em USING (beam)),
tidy AS (SELECT beam, 'EM' AS metric, em AS value FROM wide UNION ALL SELECT beam, 'BLEU', bleu FROM wide
  UNION ALL SELECT beam, 'ngram', ng FROM wide UNION ALL SELECT beam, 'MOSES', mo FROM wide
  UNION ALL SELECT beam, 'weighted_ngram', wn FROM wide UNION ALL SELECT beam, 'syntax', tree FROM wide
  UNION ALL SELECT beam, 'dataflow', flow FROM wide
  UNION ALL SELECT beam, 'composite', 0.25 * (ng + wn + tree + flow) FROM wide)"""


@query("metric_best_beam", f"""WITH {_BEAM_METRICS}
SELECT metric, round(max(value), 6) AS value FROM tidy GROUP BY metric""")
def metric_best_beam(spark, sf):
    return S.best_over_beams(beam_metrics(spark, sf)).select("metric", r6(F.col("value"), "value"))


@query("metric_report", f"""WITH {_COMPONENTS},
em AS (SELECT 100.0 * sum(CASE WHEN hyp = ref THEN 1 ELSE 0 END) / count(*) AS em FROM pairs),
parts AS (SELECT 'ngram' AS metric, 100 * {V.sql_epsilon()} AS value FROM corpus
  UNION ALL SELECT 'weighted_ngram', 100 * {V.sql_recall()} FROM corpus
  UNION ALL SELECT 'syntax', 100 * (matched / total) FROM treesum
  UNION ALL SELECT 'dataflow', 100 * (matched / total) FROM edgesum)
SELECT metric, round(value, 2) AS value FROM (
  SELECT * FROM parts UNION ALL SELECT 'composite', 0.25 * sum(value) FROM parts
  UNION ALL SELECT 'EM', em FROM em UNION ALL SELECT 'BLEU', 100 * {V.sql_smoothed()} FROM corpus
  UNION ALL SELECT 'MOSES', {V.sql_plain()} FROM corpus)""")
def metric_report(spark, sf):
    """The flagship report: every corpus metric of the conversation pairs."""
    parts = component_scores(spark, sf, BLEU=S.bleu_smoothed(), MOSES=S.bleu_plain() / 100)
    parts = parts.select("metric", (100 * F.col("value")).alias("value"))
    em = V.pairs(spark, sf).agg(S.exact_match(F.col("hyp"), F.col("ref")).alias("value")).select(
        F.lit("EM").alias("metric"), "value")
    names = ["EM", "BLEU", "MOSES", *QUARTERS]
    return S.report(parts.unionByName(em), names, QUARTERS).select("metric", F.round("value", 2).alias("value"))


# ---- bags -----------------------------------------------------------------

@query("bag_intersection", f"""WITH {V.SQL_PAIRS}, {V.sql_stats("pairs", PAIR, 2)}
SELECT conv_id, turn, n, g AS gram, least(ch, cr)::BIGINT AS cnt FROM bags WHERE ch > 0 AND cr > 0""")
def bag_intersection(spark, sf):
    return G.bag_intersection(G.bag_rows(V.token_pairs(spark, sf), PAIR, "hyp", "ref", 2), PAIR)


@query("bag_max_merge", f"""WITH {_multi_sql()}
SELECT n, count(*) AS grams, sum(cr)::BIGINT AS total, max(cr)::BIGINT AS most FROM bags WHERE cr > 0 GROUP BY n""")
def bag_max_merge(spark, sf):
    _, refs = V.multi_ref(spark, sf)
    return G.bag_max_merge(refs, PAIR, "ref_no", "ref").groupBy("n").agg(
        F.count(F.lit(1)).alias("grams"), F.sum("cnt").alias("total"), F.max("cnt").alias("most"))
