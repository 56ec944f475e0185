"""Hot keys: results over groups that hold most rows, against plain Python."""
from collections import Counter

from pyspark.sql import functions as F

from tandem.operators import corpus as C
from tandem.operators import ngrams as G
from tandem.operators import runs as R
from tandem.operators import scores as S


def grams(tokens, n):
    return Counter(" ".join(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def test_one_pair_with_most_references(spark):
    hyps = [(0, "a b c d e".split()), (1, "a b".split()), (2, [])]
    refs = [(0, i, [chr(97 + (i * k) % 7) for k in range(1, 4 + i % 6)]) for i in range(600)]
    refs += [(1, 0, "a b c".split()), (2, 0, ["x"])]
    h = spark.createDataFrame(hyps, "id long, hyp array<string>")
    r = spark.createDataFrame(refs, "id long, ref_no long, ref array<string>")
    got = {x.id: x for x in G.multi_ref_stats(h, r, ["id"]).collect()}
    for key, hyp in hyps:
        mine = [t for k, _, t in refs if k == key]
        for n in range(1, 5):
            top = Counter()
            for t in mine:
                top |= grams(t, n)
            assert got[key][f"m{n}"] == sum((grams(hyp, n) & top).values())
        assert got[key].ref_len == min((abs(len(t) - len(hyp)), len(t)) for t in mine)[1]
    short = G.multi_ref_stats(h, r, ["id"], ref_len="shortest").filter("id = 0").first().ref_len
    assert short == 3


def test_recall_over_references(spark):
    hyp, refs = "return a b".split(), ["return a".split(), "b b return c".split()]
    df = spark.createDataFrame([(1, j, hyp, r) for j, r in enumerate(refs)],
                               "id long, ref_no long, hyp array<string>, ref array<string>")
    stats = G.match_stats(df, ["id", "ref_no"], keywords=["return"])
    row = S.recall_stats(stats, ["id"]).first()
    assert (row.pairs, row.hyp_len, row.m2, row.r2) == (1, 3, 1, 1 + 3)
    assert row.wm1 / 5 == (1 + 0.2) + (1 + 0.2) and row.wr1 / 5 == 1.2 + (1 + 3 * 0.2)


def test_one_problem_with_most_attempts(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("problem_id"),
        F.col("id").cast("int").alias("beam"),
        F.when(F.col("id") % 1000 == 998, "success").otherwise("failure").alias("status"),
        F.lit(None).cast("string").alias("detail"))
    kept = R.until_success(df)
    hot = kept.filter("problem_id = 0").agg(F.max("beam").alias("b"), F.count("*").alias("n")).first()
    first = min(i for i in range(30000) if i % 3 > 0 and i % 1000 == 998)
    # id 0 belongs to problem 0 as well
    assert hot.b == first and hot.n == 1 + sum(i % 3 > 0 for i in range(first + 1))


def test_copies_of_one_text(spark):
    df = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 1, "same").otherwise(
        F.concat(F.lit("t"), F.col("id") % 50)).alias("text"))
    got = sorted(r.id for r in C.representatives(df, "id", "text").collect())
    first = {}
    for i in range(9000):
        first.setdefault("same" if i % 3 == 1 else f"t{i % 50}", i)
    assert got == sorted(first.values())
