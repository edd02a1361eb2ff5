"""Queries of learned operators against plain loops over the same tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_quality_rules import WORD, brute
from tidemark.llm import language, queries, quality_fm, quality_rules, toxicity
from tidemark.llm.base import WordHash, table

SF = "/root/testdata/sf0.01"


def rows_of(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    return docs, labels


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def area(scores, truth):
    """Share of pairs of a positive and a negative that the scores put in order."""
    pos, neg = (np.array([s for s, y in zip(scores, truth) if y == v]) for v in (1, 0))
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_quality_scores(spark):
    docs, labels = rows_of(spark)
    machine = quality_fm.train(table(spark, SF, "documents"), table(spark, SF, "labels"), quality_fm.training_fold(F.col("doc_id")))
    got = {r.doc_id: r for r in queries.op3_quality(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, r in got.items():
        places = quality_fm.inputs((docs[k].text or "").encode(), docs[k].n_chars, WordHash())
        x = quality_fm.weights(places)
        m = machine.bias + machine.linear[places] @ x
        for i in range(min(len(places), 60)):  # all pairs, one by one, where they are few
            if len(places) <= 60:
                m += sum(x[i] * x[j] * (machine.factors[places[i]] @ machine.factors[places[j]]) for j in range(i))
        if len(places) <= 60:
            assert abs(r.score - 1 / (1 + np.exp(-m))) < 1e-4
        assert r.held_out == (fold(k, 3) == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [k for k in got if got[k].held_out and k in labels]
    assert area([got[k].score for k in held], [labels[k].quality for k in held]) > 0.98


def test_toxicity_scores(spark):
    docs, labels = rows_of(spark)
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"), toxicity.training_fold(F.col("doc_id")))
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, r in got.items():
        x = toxicity.features((docs[k].text or "").encode(), model.lexicon).astype("<f4").astype(float)
        m = model.trees.base
        for split, leaves in zip(model.trees.splits, model.trees.leaves):
            node = 0
            for _ in range(toxicity.DEPTH):
                f, b = split[node]
                node = 2 * node + 1 + int((model.trees.edges[f] < x[f]).sum() > b)
            m += leaves[node - (2**toxicity.DEPTH - 1)]
        p = np.clip(np.interp(m, *model.knots) + 1e-4 * (1 / (1 + np.exp(-m)) - 0.5), 0, 1)
        assert abs(r.score - p) < 1e-9 and r.held_out == (fold(k, 5) == 0) and r.predicted == int(r.score >= 0.5)
    held = [k for k in got if got[k].held_out and k in labels]
    assert area([got[k].score for k in held], [labels[k].toxic for k in held]) > 0.8


def test_languages(spark):
    docs, _ = rows_of(spark)
    model = language.train(table(spark, SF, "documents"), language.training_fold(F.col("doc_id")))
    got = {r.doc_id: r for r in queries.op10_language(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, r in got.items():
        text = docs[k].text
        assert r.held_out == (fold(k, 4) == 2) and 0 <= r.score <= 1
        if not any(map(str.isalpha, text or "")):
            assert r.lang_pred == "und"
            continue
        z = [float(w @ language.rates(text.encode())) + b for w, b in zip(model.weights, model.biases)]
        f = max(range(len(model.families)), key=lambda i: z[i]) if len(model.families) > 1 else 0
        votes = Counter({m: 0 for m in model.members[f]})
        for m, a, b in model.pairs[f]:
            votes[model.members[f][a if z[m] >= 0 else b]] += 1
        assert votes[r.lang_pred] == max(votes.values())
    held = [k for k in got if got[k].held_out and docs[k].lang and got[k].lang_pred != "und"]
    assert np.mean([got[k].lang_pred == docs[k].lang for k in held]) > 0.98


def test_more_languages_than_two_hundred(spark):
    rows = [(k, f"{chr(97 + k // 26 % 26) * 3}{chr(97 + k % 26) * 4} word " * 5, f"x{k % 230}") for k in range(460)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.train(d, F.lit(True)).families) == 230


def test_quality_rules_list(spark):
    """A learned list, applied by a plain loop to numbers counted by a plain loop."""
    r = random.Random(8)
    docs, labels = [], []
    for k in range(500):
        w = ["".join(r.choice(["ba", "ko", "ri"]) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(40, 110))]
        bad = r.random() < 0.3
        docs.append((k, ("!! " if bad else " ").join(w) + ("###" if bad and k % 2 else "."), 1))
        labels += [(k, int(not bad), 0)] * (1 + k % 2)
    docs += [(1, None, 2), (1, "", 2), (None, "a " * 60, 2), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string, kept int")
    lab = spark.createDataFrame([*labels, (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(quality_rules.materialise(quality_rules.statistics(d), "t"), lab)
    assert rules
    got = Counter(map(tuple, quality_rules.report(d, lab).collect()))
    want = Counter()
    for i, t, _ in docs:
        n, chars, symbols, dup, repeat, failed = brute(t)
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        count = lambda p: len(re.findall(p, t))  # noqa: E731, B023
        rates = {
            "symbol_rate": symbols / max(n, 1), "dup_line_rate": dup / max(len(lines), 1), "repeat_rate": repeat / max(n, 1), "distinct_rate": len(set(w)) / max(n, 1),
            "word_length": chars / max(n, 1), "capital_rate": count("[A-Z]") / max(len(t), 1), "exclaim_rate": count("!") / max(n, 1), "bar_rate": count(r"\|") / max(n, 1),
            "digit_rate": count("[0-9]") / max(len(t), 1), "stop_rate": count("[.,;:?]") / max(n, 1), "line_words": n / max(len(lines), 1), "word_count": float(n),
        }
        rejected = any(all((rates[x.feature] > x.threshold) == x.above for x in rule) for rule in rules)
        want[i, n, chars, symbols, dup, repeat, failed, not failed and not rejected] += 1
    assert got == want
