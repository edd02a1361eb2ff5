import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import base
from tidemark.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    covered = {k for i, g in enumerate(grams) if c[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_base_statistics_match_brute_force(spark):
    r = random.Random(2)
    bits = ["a", "b", "é😀", "c#", " ", "  ", "\n", "\t", "\r\n", "|", "<>", "\xa0", "\x1c", "\n\n", "a b c ", "x\n"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(120))) for _ in range(300)] + [None, "", " ", "\n", "w " * 30000, "same line here\n" * 40]
    d = spark.createDataFrame([(k, t, 1, "s") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, w string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for x in Q.report(d, labels).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(texts[x.doc_id]), texts[x.doc_id]
        assert x.kept == (not x.base_failed)
    assert Q.report(d.limit(0), labels).count() == 0


def test_rules_reject_low_quality_and_keep_the_rest(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["ba", "ko", "ri", "tu", "men", "so"]) for _ in range(r.randrange(1, 5)))
    docs, truth = [], {}
    for k in range(900):
        w = [word() for _ in range(r.randrange(60, 120))]
        kind = r.choice(["good"] * 6 + ["caps", "marks"])
        docs.append((k, {"good": " ".join(w) + ".", "caps": " ".join(x.upper() + "!!" for x in w), "marks": " ".join(x + "###" for x in w)}[kind]))
        truth[k] = int(kind == "good")
    labels = [(k, truth[k], 0) for k in range(0, 900, 2)] + [(None, 0, 0), (4, None, 0), (6, truth[6], 0)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stats = Q.materialise(Q.statistics(d), "s")
    rules = Q.learn(stats, lab)
    assert 1 <= len(rules) <= 6 and "CASE WHEN" in str(Q.verdict(rules))
    got = {x.doc_id: x.kept for x in stats.select("doc_id", Q.verdict(rules).alias("kept")).collect()}
    assert np.mean([got[k] == bool(truth[k]) for k in range(1, 900, 2)]) > 0.98


def test_labelled_rows_lie_in_few_files_however_many_partitions_the_join_has(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(60)) + "!" * (k % 7), "en") for k in range(600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, quality int")
    stats = Q.statistics(docs).cache()
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before, since = {k: spark.conf.get(k) for k in own}, len(base.WRITTEN)
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        Q.learn(stats, labels)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tables = [spark.read.parquet(p) for p in base.WRITTEN[since:]]
    assert len(tables) == 2 and all(t.filter("word_count >= 50").count() == t.count() > 0 for t in tables)
    assert all(len(t.inputFiles()) <= Q.SAMPLE_PARTS for t in tables)
