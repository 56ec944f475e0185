"""Published BLEU examples and small hand-made cases."""
import pytest
from pyspark.sql import functions as F

from tandem.operators import ngrams as G
from tandem.operators import scores as S

HYP1 = "It is a guide to action which ensures that the military always obeys the commands of the party".split()
HYP2 = "It is to insure the troops forever hearing the activity guidebook that party direct".split()
REFS = [r.split() for r in (
    "It is a guide to action that ensures that the military will forever heed Party commands",
    "It is the guiding principle which guarantees the military forces always being under the command of the Party",
    "It is the practical guide for the army always to heed the directions of the party")]
HYP3 = "he read the book because he was interested in world history".split()
REF3 = "he was interested in world history because he read the book".split()


def stats(spark, cases, max_n=4):
    hyps = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "id long, hyp array<string>")
    refs = spark.createDataFrame([(i, j, r) for i, (_, rs) in enumerate(cases) for j, r in enumerate(rs)],
                                 "id long, ref_no long, ref array<string>")
    return G.multi_ref_stats(hyps, refs, ["id"], max_n=max_n)


def one(df, expr):
    return df.select(expr.alias("x")).first().x


def sentence(spark, hyp, refs, expr, max_n=4):
    return one(S.sentence_stats(stats(spark, [(hyp, refs)], max_n), ["id"], max_n), expr)


@pytest.mark.parametrize("hyp, weights, want", [
    (HYP1, (0.25,) * 4, 0.504567), (HYP2, (0.25,) * 4, 0.037031), (HYP1, (0.2,) * 5, 0.392026)])
def test_sentence_bleu(spark, hyp, weights, want):
    assert sentence(spark, hyp, REFS, S.bleu_epsilon(weights), len(weights)) == pytest.approx(want, abs=1e-6)


def test_corpus_bleu_is_not_the_mean(spark):
    s = stats(spark, [(HYP1, REFS), (HYP3, [REF3])])
    assert one(S.corpus_stats(s), S.bleu_epsilon()) == pytest.approx(0.592078, abs=1e-6)
    mean = S.sentence_stats(s, ["id"]).select(S.bleu_epsilon().alias("x")).agg(F.avg("x").alias("x")).first().x
    assert mean == pytest.approx(0.622325, abs=1e-6)


@pytest.mark.parametrize("hyp, refs, n, want", [
    ("the the the the the the the".split(), ["the cat is on the mat".split(), "there is a cat on the mat".split()], 1, 2 / 7),
    ("of the".split(), REFS, 1, 1.0), ("of the".split(), REFS, 2, 1.0), (HYP1, REFS, 1, 17 / 18),
    (HYP2, REFS, 1, 8 / 14), (HYP1, REFS, 2, 10 / 17), (HYP2, REFS, 2, 1 / 13)])
def test_modified_precision(spark, hyp, refs, n, want):
    assert sentence(spark, hyp, refs, F.col(f"m{n}") / F.col(f"q{n}")) == pytest.approx(want)


@pytest.mark.parametrize("refs, hyp, want", [
    ((12, 15, 17), 12, 1.0), ((28, 28), 12, 0.263597), ((13, 2), 12, 0.920044), ((13, 11), 12, 1.0),
    ((11, 13), 12, 1.0), ((11, 8), 7, 0.866878), ((11, 8, 6, 7), 7, 1.0)])
def test_brevity_penalty(spark, refs, hyp, want):
    got = sentence(spark, ["a"] * hyp, [["a"] * r for r in refs], S.penalty(F.col("hyp_len"), F.col("ref_len")))
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("method, want", list(enumerate(
    [0.4118, 0.4118, 0.4489, 0.4118, 0.4118, 0.4905, 0.4135, 0.4905])))
def test_smoothing(spark, method, want):
    got = sentence(spark, HYP1, REFS[:1], S.bleu_with_smoothing(method), 5)
    assert int(got * 10000) / 10000 == pytest.approx(want)


def test_smoothing_with_zero_counts(spark):
    hyp, refs = "a b c".split(), ["a x c".split()]
    df = S.sentence_stats(stats(spark, [(hyp, refs)], 5), ["id"], 5)
    p3 = df.select(*[c.alias(f"p{i}") for i, c in enumerate(S.smoothed_precisions(3))]).first()
    assert list(p3) == pytest.approx([2 / 3, 1 / 4, 1 / 4, 1 / 8])
    assert one(df, S.bleu_with_smoothing(6)) is None


def test_short_and_empty_pairs(spark):
    df = spark.createDataFrame([(1, ["a"], ["b"]), (2, [], ["b"]), (3, ["a"], ["a"])],
                               "id long, hyp array<string>, ref array<string>")
    s = S.corpus_stats(G.match_stats(df, ["id"]))
    row = s.first()
    assert (row.hyp_len, row.ref_len, row.m1, row.p1, row.q1, row.p4, row.q4) == (2, 3, 1, 2, 3, 0, 3)


def test_auto_reweigh(spark):
    assert sentence(spark, ["a"], [["a"]], S.bleu_epsilon(auto_reweigh=True)) == pytest.approx(1.0)
    assert sentence(spark, ["a"], [["a"]], S.bleu_epsilon()) < 1.0


def test_weighted_recall(spark):
    df = spark.createDataFrame([(1, "return x ;".split(), "return y ; }".split())],
                               "id long, hyp array<string>, ref array<string>")
    s = S.corpus_stats(G.match_stats(df, ["id"], keywords=S.KEYWORDS["java"]), weighted=True)
    uni = (1 + 0.2) / max(1, 1 + 0.2 * 3)
    want = (uni * (0.1 / 3) * (0.1 / 2) * 0.1) ** 0.25
    assert one(s, S.bleu_recall()) == pytest.approx(want)  # three tokens exceed the constant reference length
    assert one(s, S.bleu_recall(true_ref_len=True)) == pytest.approx(want * 2.718281828 ** (1 - 4 / 3))


def test_keywords_from_a_file(spark, tmp_path):
    from tandem.sources import readers as R
    (tmp_path / "kw.txt").write_text("return\n if \nreturn\n")
    df = spark.createDataFrame([(1, "return if x".split(), "return if y".split())],
                               "id long, hyp array<string>, ref array<string>")
    listed = G.match_stats(df, ["id"], keywords=["return", "if"]).first()
    read = G.match_stats(df, ["id"], keywords=R.keywords(spark, str(tmp_path / "kw.txt"), "go")).first()
    assert listed == read and (read.k1, read.ref_kw) == (2, 2)


def test_overlap_rules(spark):
    items = spark.createDataFrame([(1, "hyp", "a"), (1, "ref", "a"), (1, "ref", "a"), (1, "ref", "b")],
                                  "id long, side string, item string")
    assert S.overlap(items, ["id"], ["item"], membership=True).first().matched == 2
    assert S.overlap(items, ["id"], ["item"]).first().matched == 1
    assert S.overlap(items.filter("side = 'hyp'"), ["id"], ["item"]).select(
        S.overlap_score(1.0).alias("x")).first().x == 1.0


def test_padding(spark):
    df = spark.createDataFrame([(1, ["1", "2"])], "id long, t array<string>")
    grams = {(r.n, r.gram) for r in G.ngram_counts(df, ["id"], "t", 2, "<s>", "</s>").collect()}
    assert grams == {(1, "1"), (1, "2"), (2, "<s> 1"), (2, "1 2"), (2, "2 </s>")}
