"""Collocations, clustering and weakly supervised rules against plain Python."""
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tandem.llm import clustering, rules
from tandem.llm.collocations import collocations
from tandem.llm.common import saved
from tests.llm import fixtures as X


@pytest.fixture(scope="module")
def docs(spark):
    return saved(X.frame(spark, X.awkward()).repartition(3), "test")


@pytest.fixture(scope="module")
def none(spark):
    return X.frame(spark, [])


# --- collocations ---

def plain_collocations(rows, longest, least, cover, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", X.lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best, around = [], defaultdict(int)
        for q, b in frequent.items():
            for p in {q[i:i + k] for k in range(2, len(q)) for i in range(len(q) - k + 1)}:
                around[p] = max(around[p], b)
        for p, a in frequent.items():
            if p in around and 100 * around[p] >= cover * a:
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("longest,least,cover,top", [(3, 3, 50, 2000), (4, 2, 80, 7), (2, 2, 50, 50)])
def test_collocations(spark, longest, least, cover, top):
    texts = [*X.awkward(), *((200 + i, t) for i, t in enumerate(
        ["New York. New York, new\tyork; NEW YORK", "a\x00b c a\x00b c\x0ba\x00b  c", "a a a a a a", ":;.", "größe Ä größe Ä"]))]
    langs = ["en", None, "de", "und", ""]
    df = spark.createDataFrame([(i, t, langs[(i or 0) % 5], 0, "x", 0) for i, t in texts],
                               "doc_id long, text string, lang string, n long, word string, block long").repartition(3)
    rows = [(langs[(i or 0) % 5], t) for i, t in texts]
    got = [tuple(r) for r in collocations(df, longest, least, cover, top).collect()]
    assert X.order(got) == X.order(plain_collocations(rows, longest, least, cover, top))


def test_collocations_over_many_blocks(spark, monkeypatch):
    from tandem.llm import collocations as C

    rows = [(i, X.prose(i % 7, 120)) for i in range(40)]
    monkeypatch.setattr(C, "BLOCK", 500)  # read where the blocks are made, so in this process only
    got = [tuple(r) for r in collocations(X.frame(spark, rows).repartition(6), 3, 4, 50, 100).collect()]
    assert X.order(got) == X.order(plain_collocations([("en", t) for _, t in rows], 3, 4, 50, 100))


def test_collocations_score_beyond_64_bits(spark):
    from tandem.llm import collocations as C

    def numbers(docs, longest, least, lang, text):
        a = 3_000_000_000
        words = spark.createDataFrame([(1, "en", b"x", a + 7), (2, "en", b"y", a + 11)], "id long, lang string, word binary, f long")
        pairs = spark.createDataFrame([(1, 2, a)], "w1 long, w2 long, f long")
        return spark.createDataFrame([("en", 10 * a)], "lang string, n long"), [words, pairs]

    before, C.frequent_phrases = C.frequent_phrases, numbers
    try:
        r = C.collocations(None, longest=2).collect()[0]
    finally:
        C.frequent_phrases = before
    a = 3_000_000_000
    assert r.score == 1000000 * a * a // ((a + 7) * (a + 11)) and (r.l, r.r) == (a + 7, a + 11)


def test_collocations_of_nothing(none):
    assert collocations(none).count() == 0


# --- clustering ---

def plain_means(rows, k, rounds, size, scale):
    kept = [(i, [max(-clustering.LARGEST, min(clustering.LARGEST, math.floor(scale * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    ordered = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(),
                                          np.array(r[1], np.int32).tobytes()))
    points = [v for _, v in ordered[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), j) for j, p in enumerate(points))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        points = [[sum(c) // len(members[j]) for c in zip(*members[j])] if j in members else p for j, p in enumerate(points)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], points


@pytest.mark.parametrize("k,rounds", [(16, 3), (5, 6), (1, 2), (400, 1), (3, 0)])
def test_shallot(spark, k, rounds):
    r = np.random.RandomState(k)
    rows = [(i, [float(x) for x in r.randint(-2, 3, 4) / 4 + r.choice([0, 3])]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(150, 170)] + [(3, rows[3][1]), (None, rows[5][1]), (None, None), (171, []),
                                                        (172, [0.5] * 3), (173, [0.0, None, 1.0, 1.0]), (174, [1e30, -1e30, 0.0, 0.0]),
                                                        (175, [0.0, float("nan"), 0.0, 0.0]), (176, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, near int, cluster int")
    found, points = clustering.shallot(df.repartition(3), k, rounds, size=4, scale=64)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, centres = plain_means(rows, k, rounds, 4, 64)
    assert X.order(tuple(x) for x in found.collect()) == X.order(want) and points.tolist() == centres
    if k == 5:
        out = clustering.with_inertia(found, points).collect()
        assert len(out) == len(want) and {x.inertia for x in out} == {sum(d for _, _, d in want)}
        for x in out:
            assert x.cluster_inertia == sum(d for _, c, d in want if c == x.cluster)
            assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[x.cluster])).encode()).hexdigest()


def test_search_equals_a_full_scan_with_less_work():
    r = np.random.RandomState(4)
    centres = r.randint(-400, 400, (24, 8))
    x = (centres[r.randint(0, 24, 3000)] + r.randint(-60, 60, (3000, 8))).astype(np.int64)
    c = clustering.Centroids(centres.astype(np.int64), np.zeros(24))
    bounds, computed = clustering.scan_all(x, c), 0
    for _ in range(5):
        new = c.points + r.randint(-6, 7, c.points.shape)
        c = clustering.Centroids(new, np.sqrt(clustering.squared(new, c.points)) * (1 + 1e-12))
        bounds, n = clustering.search(x, bounds, c)
        whole = clustering.scan_all(x, c)
        assert (bounds.near == whole.near).all() and (bounds.upper >= np.sqrt(clustering.squared(x, c.points[bounds.near]))).all()
        assert (bounds.lower <= whole.lower * (1 + 1e-9)).all()
        computed += n
    assert computed < 5 * 3000 * 24 / 3


def test_shallot_of_nothing(spark):
    found, points = clustering.shallot(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert clustering.with_inertia(found, points).count() == 0


# --- rules ---

def plain_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {i + j for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] > 1 for j in range(3)}
    def letter(c):
        return c.isascii() and c.isalpha() or not c.isascii()
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_lines": len(lines),
            "n_digits": len(re.findall("[0-9]", text)), "n_upper": len(re.findall("[A-Z]", text)),
            "n_letter_words": sum(any(map(letter, x)) for x in w), "n_distinct": len(set(w)),
            "n_stops": sum(x[-1] in ".!?" for x in w), "n_bullets": sum(x.strip(" \t\n\v\f\r")[0] in "-*+" for x in lines),
            "n_letters": sum(map(letter, text)), "n_plain_words": sum(all(letter(c) or c in "0123456789" for c in x) for x in w)}


LINES = ["- one\n- one\n\n * two\n- one", "a b c a b c a b", "x\nx\n x\nx \r\nx", "\n\n", "### $$$ a|b <c>", "ab ab ab ab", "a\x00b \x00",
         "é日 x é日 x y"]


def test_counts(spark):
    rows = [*X.awkward(), *((300 + i, t) for i, t in enumerate(LINES))]
    got = rules.counted(X.frame(spark, rows).repartition(2)).collect()
    want = [(i, *(plain_stats(t)[k] for k in rules.STATS)) for i, t in rows]
    assert X.order(tuple(r) for r in got) == X.order(want)


def plain_estimation(votes, rounds, prior, expected):
    """The same estimation, document by document."""
    m = len(votes[0])
    share, good, bad = 0.5, [expected[0]] * m, [expected[1]] * m
    for _ in range(rounds):
        p = []
        for v in votes:
            a, b = share, 1 - share
            for j, x in enumerate(v):
                if x:
                    a *= good[j] if x > 0 else 1 - good[j]
                    b *= 1 - bad[j] if x > 0 else bad[j]
            p.append(a / (a + b))
        for j in range(m):
            cast = [(q, v[j]) for q, v in zip(p, votes) if v[j]]
            w = prior * len(cast) + 1e-9
            g = (sum(q for q, x in cast if x > 0) + w * expected[0]) / (sum(q for q, _ in cast) + w)
            h = (sum(1 - q for q, x in cast if x < 0) + w * expected[1]) / (sum(1 - q for q, _ in cast) + w)
            good[j] = min(max(g, 1e-4), 1 - 1e-4)
            bad[j] = max(min(max(h, 1e-4), 1 - 1e-4), 1 - good[j])
        share = min(max(sum(p) / len(p), 0.01), 0.99)
    return p, share


def test_estimation_equals_that_over_documents():
    r = np.random.RandomState(8)
    truth = r.rand(400) < 0.8
    votes = np.where(r.rand(400, 5) < 0.25, 0, np.where((r.rand(400, 5) < 0.85) == truth[:, None], 1, -1))
    kinds, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = rules.fit(kinds, counts, rounds=12)
    _, share = plain_estimation(votes.tolist(), 12, 0.02, (0.98, 0.2))
    p, _ = plain_estimation(votes.tolist(), 13, 0.02, (0.98, 0.2))
    assert abs(model.share - share) < 1e-9
    mine = 1 / (1 + np.exp(-model.odds(kinds)))[of.ravel()]
    assert np.abs(mine - p).max() < 1e-6 and ((mine > 0.5) == truth).mean() > 0.9


def test_rules_outvote_each_other(spark):
    good = [(i, ". ".join(X.prose(1000 * i + j, 12).capitalize() for j in range(12)) + ".\n" + X.prose(i, 20) + ".") for i in range(80)]
    junk = [(100 + i, " ".join(f"{w}###" for w in X.prose(i, 150).split())) for i in range(12)]
    again = [(200 + i, "\n".join(["BUY NOW " + X.prose(i, 4)] * 40)) for i in range(12)]
    df = X.frame(spark, [*good, *junk, *again, (None, None), (300, "")]).repartition(3)
    rows = {r.doc_id: r for r in rules.judged(df).collect()}
    assert len(rows) == 106 and all(0 <= r.p_good <= 1 for r in rows.values())
    assert all(rows[i].good for i, _ in good) and not any(rows[i].good for i, _ in [*junk, *again])


def test_probability_in_sql_equals_that_of_the_model(spark):
    model = rules.Votes(0.7, np.array([0.9, 0.8, 0.99]), np.array([0.3, 0.6, 0.2]))
    got = spark.range(27).select(model.probability("id").alias("p")).toPandas().p.to_numpy()
    assert np.abs(got - 1 / (1 + np.exp(-model.odds(rules.unpacked(np.arange(27), 3))))).max() < 1e-12


def test_rules_of_nothing(none):
    assert rules.judged(none).count() == 0
