import random
import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import spelling as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    v = vocabulary(rows)
    near = {w: sorted((-v[x], x) for x in v if one_apart(w, x)) for w in v}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 10 * v[w] else None for w in v}
    out = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, v[w], len(near[w]), form[w], v[form[w]] if form[w] else None, root))
    return sorted(out)


def corpus():
    r = random.Random(3)
    base = ["".join(r.choice("abcdeé÷") for _ in range(r.randrange(6, 11))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaaaa", "Straße" + "ÀÿÞ", "bookkeeper", "bokkeeper"]
    rows = []
    for d in range(250):
        words = []
        for _ in range(r.randrange(60)):
            w = base[int(len(base) * r.random() ** 3)]
            if r.random() < 0.15:
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcx") + w[i + 1 :], w[:i] + r.choice("abcx") + w[i:]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((r.randrange(10**6), r.choice([" ", ", ", "_", "1"]).join(words)))
    chain = [("chainedword", 300), ("chainedwords", 29), ("chainedwordss", 2)]
    rows += [(8, " ".join([w] * n)) for w, n in chain]
    return rows + [(1, None), (2, ""), (None, "nullwords nullwords"), (5, rows[0][1]), (5, rows[0][1])]


def test_matches_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    d = spark.createDataFrame([(*x, "a", 1) for x in rows], "doc_id long, text string, word string, n long")
    got = sorted(map(tuple, S.variants(d).select("word", "n", "n_near", "form", "form_n", "root").collect()))
    assert got == want
    assert sum(x[3] is not None for x in want) > 30 and any(x[3] != x[5] for x in want if x[3]), "forms, and chains of them"


def test_deletions_and_long_words(spark):
    keys = {w: S.deletion_keys(w) for w in ("aabc", "abc", "aab", "aac", "", "é")}
    assert [len(keys[w][0]) for w in ("aabc", "abc", "", "é")] == [4, 4, 1, 2]
    assert keys["aabc"][0][1] == keys["abc"][0][0] and (keys["aabc"][1][1], keys["aabc"][2][1]) == (0, 1)
    assert keys["é"][0][1] == keys[""][0][0]
    assert len(np.unique(S.deletion_keys("ab" * 50_000)[0])) == 100_001
    long = "xyz" * 60_000
    rows = [(1, f"{long} {long}a {long}"), (1, f"{long[:-1]} {long[:-1]}"), (2, f"{long}a")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(len(r.word), r.n_near) for r in S.variants(d).collect()} == {(len(w), sum(one_apart(w, x) for x in vocabulary(rows))) for w in vocabulary(rows)}
    assert S.variants(d.limit(0)).count() == 0
