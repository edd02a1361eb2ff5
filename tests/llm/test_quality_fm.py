import random

import numpy as np

from tidemark.llm import quality_fm as Q


def corpus(n=500, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ko", "ri", "tu", "men"]) for _ in range(r.randrange(1, 4)))
    docs, labels = [], []
    for k in range(n):
        good = r.random() < 0.7
        w = [word() for _ in range(r.randrange(20, 80))]
        t = " ".join(w).capitalize() + "." if good else r.choice([" ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 50), " | ".join(w)])
        docs.append((k, t, len(t)))
        if k % 4:
            labels.append((k, int(good), 0))
    return docs, labels


def test_linear_time_score_equals_all_pairs():
    r = np.random.default_rng(1)
    m = Q.Machine(0.3, r.normal(size=Q.PLACES), r.normal(size=(Q.PLACES, Q.RANK)))
    p = np.array([3, 50, 900, Q.WORDS + 1, Q.WORDS + 40])
    x = Q.weights(p)
    pairs = sum(m.factors[p[a]] @ m.factors[p[b]] * x[a] * x[b] for a in range(len(p)) for b in range(a))
    assert abs(m.margin(p) - (0.3 + m.linear[p] @ x + pairs)) < 1e-9


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    docs += [(None, None, None), (901, "", -5), (902, " \n ", 3), (5, "again", 5), (903, "ba " * 60000, 9)]
    d = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, n_chars long, score int, _quality string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), labels[0]], "doc_id long, quality int, toxic int")
    got = Q.report(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {k: y for k, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in Q.report(d, none).collect()} == {1}
    assert Q.report(d.limit(0), none).count() == 0
