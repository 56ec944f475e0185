"""Small tables with every awkward case, and plain ways to get the same results."""
import hashlib
import random
import re
from collections import Counter, defaultdict

WORDS = "alpha beta gamma delta one two three four five six seven eight nine ten lorem ipsum dolor sit".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(n))


def awkward():
    """Nulls, empty and very long texts, ties, repeated rows, near copies and other scripts."""
    passage, base = prose("passage", 90), prose("base", 200).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in (3, 60, 120)]
    return [
        (1, None), (2, ""), (3, " \n\t "), (None, "a text without an id"), (4, "word"), (5, "Two words"),
        (6, "the same text"), (7, "the same text"), (7, "the same text"), (8, prose("long", 40000)),
        (9, f"{prose(9, 50)} {passage} {prose(90, 40)}"), (10, f"{prose(10, 30)} {passage}"), (11, passage),
        (12, " ".join(base)), *((13 + i, t) for i, t in enumerate(near)), (16, "a" * 1500),
        (17, "été über straße 日本語 テキスト Ünïcode"), (18, "ab " * 400), (None, None), (19, prose("long", 40000)),
        (20, passage[:-40] + " and then another end of the passage"),
    ]


def frame(spark, rows):
    """Documents with more columns, some of them named like the operators' own."""
    more = "row long, content long, key string, name string, n long, token long, p double, host string, path string"
    return spark.createDataFrame([(i, t, "en", "src", *[None] * 9) for i, t in rows],
                                 f"doc_id long, text string, lang string, source string, {more}")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(rows, n, num, den):
    """(id, set size, least id) of each row, by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in where[x] if j < i).items():
            if den * shared >= num * (len(s) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[root(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))]


def without_repeats(rows, length):
    """(id, bytes, removed, runs, digest of the rest) of each row, by counting all strings."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[a:a + length] for t in raw for a in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, raw):
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if seen[t[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        rest = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def contamination(rows, items, span=10):
    """(id, words, hit words, item ids) of each row, by comparing all windows."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = defaultdict(set)
    for item_id, t in items:
        w = words(t)
        size = min(span, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i:i + size])].add(item_id)
    out = []
    for doc_id, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        out.append((doc_id, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def order(rows):
    return sorted(rows, key=repr)
