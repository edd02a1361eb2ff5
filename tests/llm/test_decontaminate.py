import hashlib
import random
import re

from tidemark.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(13, len(w))
            windows += [(str(i), tuple(w[a : a + n])) for a in range(len(w) - n + 1)]
    out = []
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for i, x in windows:
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit |= set(range(a, a + len(x)))
                    met.add(i)
        digest = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(met), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def cases(seed=0):
    r = random.Random(seed)
    vocab = ["a", "b", "c", "Dé", "e1", "ß", "X"]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 12, 13, 14, 30])))) for k in range(25)]
    items += [(3, "a b c d"), (None, "x y z"), (90, None), (91, " .,"), (92, "a " * 40)]
    docs = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 12, 13, 60, 300])))) for k in range(40)]
    for k in range(40, 80):
        t = items[r.randrange(25)][1].upper().replace(" ", ", ")
        docs.append((k, " ".join(["zz%d" % r.randrange(9) for _ in range(r.randrange(80))]) + " " + t + " end"))
    docs += [(1, None), (None, "a b c d"), (2, ""), (2, ""), (81, "a " * 500)]
    return docs, items


def test_matches_brute_force_and_blocks_agree(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted(map(tuple, D.report(d, b).collect()), key=repr) == want
    out, s = D.annotate(d, b, block_bytes=200)
    got = [(r.doc_id, r[s].n_words, r[s].n_hit, len(r[s]["items"]), r[s].items_sha256, r[s].contaminated) for r in out.collect()]
    assert sorted(got, key=repr) == want


def test_clashing_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b", 5, None), (2, "q", 6, None)], "doc_id long, text string, _met int, n_words string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]
    assert D.report(d.limit(0), b).count() == 0
    assert D.report(d, b.limit(0)).filter("contaminated or n_hit > 0").count() == 0


def test_equal_words_take_time_in_proportion():
    import time

    import numpy as np

    n = 20_000
    block = D.Block([("one", b"a " * n), ("two", b"b " + b"a " * n), ("short", b"a")])
    cache = D.WordHash()
    words = cache.of(D.words_of(b"a " * n))
    began = time.time()
    found = D.find(words, np.array([0, n]), block)
    assert time.time() - began < 1
    assert found == {0: ([(0, n)], {0, 1, 2})}
