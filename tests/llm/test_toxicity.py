import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T


def corpus(n=700, seed=5):
    r = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tu", "men", "sol"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    docs, labels = [], []
    for k in range(n):
        w = [word() for _ in range(r.randrange(5, 60))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["zorgle" + word(), "blarf", "idiot"]))
        docs.append((k, " ".join(w), 1.0, "x"))
        if k % 4:
            labels.append((k, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    docs += [(None, None, 0.0, "y"), (9001, "", 0.0, "y"), (9002, "!!! ...", 0.0, "y"), (5, "again", 0.0, "y"), (9003, "ba ko " * 40000, 0.0, "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double, _toxicity string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), labels[0]], "doc_id long, quality int, toxic int")
    got = T.report(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {k: y for k, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = T.reject(d, lab)
    assert kept.columns == d.columns and 0 < kept.count() < len(docs)


def test_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in T.report(d, none).collect()} == {0}
    assert T.report(d.limit(0), none).count() == 0


def test_isotonic_rises():
    r = np.random.default_rng(0)
    m = r.normal(size=400)
    x, y = T.isotonic(m, (m + r.normal(size=400) > 0).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= -1e-12).all() and 0 <= y.min() <= y.max() <= 1
