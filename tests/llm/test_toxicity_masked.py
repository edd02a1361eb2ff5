import pickle

from tidemark.llm import toxicity as T

LEXICON = T.Lexicon(words=frozenset([b"blarf", b"io"]))


def seen(text):
    f = dict(zip(T.FEATURES, T.features(text.encode(), LEXICON)))
    return f["insult"], f["hidden"] > 0


def test_masked_insults():
    for w in ("st*pid", "st*upid", "$tupid", "tra$h", "1diot", "!d!ot", "id!ot!!", "m0ron", "bl@rf", "b*arf", "imb*cile", "idio*", "*diot", "l*s*r", "cr*tin", "Tr@$H"):
        assert seen(f"what a {w} said") == (1, True), w


def test_what_is_not_masked():
    for w in ("idiot!", "*idiot*", "**stupid**", "idiot!you", "$trash"):
        assert seen(f"what a {w} said") == (1, w == "idiot!you"), w
    for w in ("$100", "10", "*word*", "hello!", "3rd", "@name", "covid19", "a***", "****", "*" * 50, "x" * 100_000 + "*"):
        assert seen(f"what a {w} said") == (0, False), w


def test_lexicon_travels():
    assert LEXICON.conceals(b"st*pid") and pickle.loads(pickle.dumps(LEXICON)).conceals(b"st*pid")
