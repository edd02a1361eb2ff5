import random

import numpy as np

from tidemark.llm import language as L

SYLLABLES = {"en": ["the", "ing", "ou", "sh"], "de": ["sch", "ung", "ei", "ü"], "fr": ["eau", "é", "ou", "que"], "es": ["ción", "ñ", "os", "la"], "xx": ["zz", "qq", "kk"]}


def corpus(n=400, seed=4):
    r = random.Random(seed)
    out = []
    for k in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 30))]
        out.append((k, " ".join(words).capitalize(), lang, "s"))
    return out


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    edges = [(None, "the ing", "en", "s"), (900, None, "en", "s"), (901, "", "fr", "s"), (902, "12 34 !!", "fr", "s"), (903, "the shing", None, "s"), (3, "eau que", "fr", "s"), (904, "sch ung " * 50000, "de", "s")]
    d = spark.createDataFrame(rows + edges, "doc_id long, text string, lang string, _language string")
    got = L.report(d).collect()
    assert len(got) == len(rows) + len(edges)
    assert sorted(r.doc_id for r in got if r.lang_pred == "und") == [900, 901, 902]
    assert all(0 <= r.score <= 1 for r in got)
    truth = {k: lang for k, _, lang, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_without_languages_or_documents(spark):
    d = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.report(d).collect()} == {"und"}
    assert L.report(d.limit(0)).count() == 0
    one = spark.createDataFrame([(k, "some text", "en") for k in range(9)] + [(10, "5", "en")], "doc_id long, text string, lang string")
    assert sorted({r.lang_pred for r in L.report(one).collect()}) == ["en", "und"]
