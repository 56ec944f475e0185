"""Predictions and posteriors against plain Python."""
import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tandem.llm import language, quality
from tests.llm import fixtures as X

WORDS = {"en": "the quick brown fox jumps over this thing with that other house", "de": "der schnelle braune fuchs springt über das haus",
         "fr": "le renard brun rapide saute par dessus cette chose été maison", "xx": "the der le fuchs fox renard été"}


def grams(text):
    """Counts of the n-grams of a text: runs of one to three letters, words' edges in those of two and three."""
    numbers, out, word = language._letters(), Counter(), []
    for c in [*(text or ""), " "]:
        x = int(numbers[ord(c)])
        if x != 1:
            word.append(x)
        elif word:
            w = [1, *word, 1]
            out.update(w[i] for i in range(1, len(w) - 1))
            out.update(w[i] << 18 | w[i + 1] for i in range(len(w) - 1))
            out.update(w[i - 1] << 36 | w[i] << 18 | w[i + 1] for i in range(1, len(w) - 1))
            word = []
    return out


def ranking(counts, top):
    return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top])}


def test_predictions_equal_plain_ones(spark):
    r, rows = np.random.RandomState(2), []
    for i in range(120):
        lang = list(WORDS)[i % 4]
        w = WORDS[lang].split()
        rows.append((i, " ".join(w[j] for j in r.randint(0, len(w), r.randint(1, 40))), lang if i % 7 else None))
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 !!", None), (203, "été " * 3000, None), (204, "a", None), (204, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for top in (300, 12):
        counts = defaultdict(Counter)
        for i, t, lang in rows:
            if lang is not None and i % 3 != 1:
                counts[lang].update(grams(t))
        profiles = {k: ranking(c, top) for k, c in counts.items() if c}
        want = []
        for i, t, _ in rows:
            own = ranking(grams(t), top)
            off = {k: sum(abs(p[g] - n) if g in p else top for g, n in own.items()) for k, p in profiles.items()}
            best = min(sorted(off), key=off.get) if own else "und"
            want.append((i, best, round(1 - off[best] / (top * len(own)), 9) if own else 0.0))
        learned = language.learn_profiles(df.where(F.col("doc_id") % 3 != 1), top=top)
        got = [(x.doc_id, x.lang_pred, round(x.score, 9)) for x in language.identify(df, learned, top=top).collect()]
        assert X.order(got) == X.order(want)


def strength(rows):
    """The beta prior's strength by moments, from (n, share, prior) of each group."""
    noise = sum(p * (1 - p) for _, _, p in rows)
    spread = sum(n * (s - p) ** 2 for n, s, p in rows)
    extra = (spread - noise) / max(sum(n for n, _, _ in rows) - len(rows), 1)
    mean = sum(n * p * (1 - p) for n, _, p in rows) / sum(n for n, _, _ in rows)
    return min(max(mean / extra - 1, 1.0), 1e6) if extra > 0 else 1e6


def test_posteriors_equal_plain_ones(spark):
    r, rows = np.random.RandomState(5), []
    for h in range(9):
        for path in range(1 + h % 4):
            rows += [(f"h{h}", f"p{path}", float(min(max(r.beta(1 + h, 3) + 0.1 * path, 0.001), 0.999))) for _ in range(r.randint(1, 60))]
    rows.append(("", "", 0.5))
    paths = defaultdict(list)
    for h, path, p in rows:
        paths[h, path].append(p)
    hosts = defaultdict(list)
    for (h, _), ps in paths.items():
        hosts[h] += ps
    prior = sum(p for *_, p in rows) / len(rows)
    k = strength([(len(ps), sum(ps) / len(ps), prior) for ps in hosts.values()])
    host = {h: (sum(ps) + k * prior) / (len(ps) + k) for h, ps in hosts.items()}
    k = strength([(len(ps), sum(ps) / len(ps), host[h]) for (h, _), ps in paths.items()])
    path = {key: (sum(ps) + k * host[key[0]]) / (len(ps) + k) for key, ps in paths.items()}

    def logit(p):
        return math.log(p / (1 - p))

    want = [(h, q, round(host[h], 9), round(path[h, q], 9), round(1 / (1 + math.exp(-(logit(p) + logit(path[h, q]) - logit(prior)))), 9))
            for h, q, p in rows]
    got = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double").repartition(3)).collect()
    assert X.order((x.host, x.path, round(x.host_share, 9), round(x.path_share, 9), round(x.posterior, 9)) for x in got) == X.order(want)
