"""The operators over whole tables, with production parameters, and their SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import clustering, pii, quality, rules, secrets
from tandem.llm.collocations import collocations
from tandem.llm.decontamination import benchmark_hits
from tandem.llm.exact_dedup import exact_groups
from tandem.llm.jaccard_join import similar_groups
from tandem.llm.language import identify, learn_profiles
from tandem.llm.packing import pack
from tandem.llm.sharding import hilbert_shards
from tandem.llm.substring_dedup import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), span=10)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       (F.size("spans") > 0).alias("contaminated"))


ORACLES["op1_decontamination"] = r"""
WITH lower AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') t
    FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') t
    FROM lower, sizes, unnest(range(1, len(w) - n + 2)) u(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, i, n FROM runs JOIN windows USING (n, t)),
covered AS (SELECT doc_id, count(DISTINCT p) n_hit FROM hits, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
    sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM lower LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), bpe_path(), size=1024).drop("row")


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), "lang", "source")
    out = hilbert_shards(docs, 24, ["lang", "source", "size", "doc_id"], tie=["text_crc32", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 3 == 1
    profiles = learn_profiles(docs.where(~held_out))
    return identify(docs.withColumn("held_out", held_out), profiles, carry=("held_out",))


def _counts(kinds: tuple[str, ...]) -> list:
    return [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in kinds]


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.train(docs))
    return found.select("doc_id", *_counts(secrets.SECRETS), "base_sha256", F.col("written").alias("spans"))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).drop("content")


ORACLES["op6_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g keep_id, count(*) OVER g group_size, doc_id = max(doc_id) OVER g kept,
    sha256(coalesce(text, '')) text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar_groups(read(spark, sf_dir, "documents"), n=4, threshold=0.85)
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.train(docs))
    return found.select("doc_id", *_counts(pii.PII), "base_sha256", F.col("written").alias("spans"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def site_path() -> Column:
    """The section of a source that a document of the supplied table lies in."""
    return F.concat_ws("/", "source", "lang")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    models = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, models, host="source", path=site_path()).drop("content")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH piece AS (SELECT coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) t FROM documents),
words AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') w FROM piece),
phrase AS (SELECT lang, k, w[i:i + k - 1] p, count(*) f FROM words, unnest([1, 2, 3]) s(k), unnest(range(1, len(w) - k + 2)) u(i)
    WHERE len(w) >= k GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT n FROM phrase WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, k, p, f a FROM phrase WHERE k > 1 AND f >= 10),
around AS (SELECT lang, p[i:i + 1] p, max(a) f FROM candidate, unnest([1, 2]) u(i) WHERE k = 3 GROUP BY ALL),
cuts AS (SELECT c.lang, c.p, c.a, j, x.f l, y.f r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) score
    FROM candidate c, unnest(range(1, c.k)) u(j)
    JOIN phrase x ON x.lang = c.lang AND x.p = c.p[1:j] JOIN phrase y ON y.lang = c.lang AND y.p = c.p[j + 1:c.k]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
kept AS (SELECT s.*, array_to_string(s.p, ' ') phrase FROM lowest s LEFT JOIN around USING (lang, p)
    WHERE around.f IS NULL OR 100 * around.f < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank, phrase, a, l, r, n,
    score::BIGINT score FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""


@query
def op12_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(*clustering.shallot(read(spark, sf_dir, "embeddings"), k=16, rounds=3, size=64))


def _rounds(n: int) -> str:
    """SQL of ``n`` rounds: assignment ``a<i>`` to centroids ``c<i>``, whose means are ``c<i + 1>``."""
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} AS (SELECT vec_id, x, c{i}.k, list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) d
    FROM vector, c{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, c{i}.k) = 1)""")
        if i < n:
            out.append(f"""m{i} AS (SELECT k, j, sum(x[j]) s, count(*) q FROM a{i}, unnest(range(1, 65)) u(j) GROUP BY k, j),
c{i + 1} AS (SELECT k, coalesce(c1, c) c FROM c{i} LEFT JOIN (SELECT k, list(((s - ((s % q) + q) % q) // q)::BIGINT ORDER BY j) c1
    FROM m{i} GROUP BY k) USING (k))""")
    return ",\n".join(out)


ORACLES["op12_shallot"] = f"""
WITH vector AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) x
    FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v)))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 k, x c FROM vector
    QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16),
{_rounds(3)}
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT distance, sum(d) OVER (PARTITION BY k)::BIGINT cluster_inertia,
    sum(d) OVER ()::BIGINT inertia, sha256(array_to_string(c, ',')) centroid_sha256
FROM a3 JOIN c3 USING (k)"""


@query
def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(read(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "p_good")
