import random
import re
import sys

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokens

E = tokens.Encoder(tokens.tokenizer_path())


def same(text):
    assert np.frombuffer(E.encode(text), "<u2").tolist() == E.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aZé19ſñ́ \xa0\x1c\x85İ漢ª²"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_equal_whole_text(text):
    same(text)


def test_words_numbers_contractions_and_special_tokens():
    r = random.Random(1)
    bits = ["don't", "we'll", " ", "  ", "\n", "\n\n ", "über", "x1y2", "'s", "a's", "!!", "<|endoftext|>", "naïve", "ab,cd", "été.", "straße", "o’er"]
    for _ in range(400):
        same("".join(r.choice(bits) for _ in range(r.randrange(20))))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 10)
    for k in range(60):
        same(f"word{k} some other text {k}")


def test_new_pieces_of_many_texts_go_to_the_library_together(monkeypatch):
    r = random.Random(9)
    odd = [" ", "\n", "\t", "\xa0", "\x1c", "　", "'s", "-x", "#", "é", "文", "😀", "0٣", "<|endoftext|>", "\r\n"]
    word = lambda: "".join(r.choice("abcdeé") for _ in range(8))
    texts = ["".join(r.choice((" ", "\n", ". ")) + word() for _ in range(40)) for _ in range(50)]
    e = tokens.Encoder(tokens.tokenizer_path())
    asked, library = [], e.tokenizer

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, some, **more):
            asked.extend(some)
            return library.encode_batch_fast(some, **more)

    monkeypatch.setattr(e, "tokenizer", Counted())
    got = list(e.encode_all(iter(texts)))
    # 2,000 words of their own: not a call a text, nor one for each word that begins a line
    assert len(asked) < 40
    texts += ["".join(r.choice(odd) for _ in range(r.randrange(30))) for _ in range(500)] + [""]
    got = list(e.encode_all(texts))
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "TOGETHER", 64)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    assert list(e.encode_all(texts)) == got and [e.encode(t) for t in texts] == got


#: The same pieces by a pattern, one string for each.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\\x00-\\x7f])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aZé19×ſñ́ \xa0\x1c\x85\x00İ漢😀ª²\u3000\u3001\u200b"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_pieces_of_many_texts_are_those_of_each(texts):
    pieces, marks = tokens.pieces_of(texts)
    pieces, marks = pieces.to_pylist(), marks.tolist()
    assert [pieces[k] for k in marks] == ["\n"] * (len(texts) + 1) and marks[0] == 0 and marks[-1] == len(pieces) - 1
    assert [pieces[a + 1 : b] for a, b in zip(marks, marks[1:])] == [PIECE.findall(t) for t in texts]


def test_a_text_longer_than_a_slice(monkeypatch):
    text = "some words, été 漢字 \n\n  x1 " * 9
    want = tokens.pieces_of([text, "", text])[0].to_pylist()
    monkeypatch.setattr(tokens, "SLICE", 7)
    assert tokens.pieces_of([text, "", text])[0].to_pylist() == want
    assert want == ["\n", *PIECE.findall(text), "\n", "\n", *PIECE.findall(text), "\n"]


def test_pieces_met_again_get_no_string_of_their_own():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefé") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=2000)) for _ in range(8)]
    e, held = tokens.Encoder(tokens.tokenizer_path()), []

    class Seen(dict):
        def get(self, key, default=None):
            held.append(sys.getallocatedblocks())
            return super().get(key, default)

    first = list(e.encode_all(texts))
    e.memory = Seen(e.memory)
    before = sys.getallocatedblocks()
    assert list(e.encode_all(texts)) == first
    # 16,000 pieces of about 1,000 kinds
    assert held and max(held) - before < 5000
