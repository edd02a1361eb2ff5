"""Token ids by the tokenizers library, with a memory for pieces of text seen lately.

The byte-level pre-tokenizer never joins letters across a change to other characters, nor anything across a space that
follows a non-space. Texts are cut at such places, each distinct piece is encoded once by the library, and the ids of a
text are those of its pieces in order. The cut places are few on purpose: a piece that isn't plain letters is a whole run
of non-spaces, so the library itself settles digits, signs and contractions inside it.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Pieces remembered; beyond them a new memory begins, into which the last one's pieces move as they are met again.
CACHE_PIECES = 200_000
#: Characters of texts whose new pieces are encoded together, and pieces to a call.
TOGETHER, GLUED = 1 << 17, 256
#: Characters looked up at once.
SLICE = 1 << 20

#: Bits of a character, by its code point; those from U+3001 on have the last entry's.
SPACE, LETTER, ASCII = 1, 2, 4
_KIND = np.zeros(0x3002, np.uint8)
_KIND[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] |= SPACE
_KIND[[k for k in range(0x100) if chr(k).isalpha() and chr(k) not in "ªµº"]] |= LETTER
_KIND[:0x80] |= ASCII


def pieces_of(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The pieces of all texts in order, with a line end before the first text and after each, and the line ends' places.

    A run of non-spaces is a piece, or two where it begins with letters and goes on with an ASCII character. One space before
    it is its own. Of other runs of spaces, the last character is a piece of its own where a non-space follows.
    """
    text = "\n".join(["", *texts, ""])
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = np.empty(len(code), np.uint8)
    for a in range(0, len(code), SLICE):  # a look-up holds more than ten bytes a character
        kind[a : a + SLICE] = _KIND[np.minimum(code[a : a + SLICE], len(_KIND) - 1)]
    space = (kind & SPACE).view(bool)
    begins = np.zeros(len(code), bool)
    begins[1:] = space[1:] & ~space[:-1]
    word = np.flatnonzero(~space[1:] & space[:-1]) + 1
    begins[word - 1] = True
    begins[word] = code[word - 1] != 0x20
    other = np.flatnonzero((kind & LETTER) == 0)
    known = kind[other]
    begins[other[1:][(known[:-1] & SPACE > 0) & (known[1:] & (SPACE | ASCII) == ASCII) & (np.diff(other) > 1)]] = True
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    begins[ends] = True
    begins[ends[:-1] + 1] = True
    at = np.flatnonzero(begins)
    marks = np.searchsorted(at, ends)
    raw = text.encode()
    if len(raw) > len(code):
        more = np.cumsum((code > 0x7F).view(np.uint8) + (code > 0x7FF).view(np.uint8) + (code > 0xFFFF).view(np.uint8), dtype=np.int32)
        at[1:] += more[at[1:] - 1]
    offsets = np.append(at, len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw)), marks


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to arrays of 16-bit ids (the vocabulary has fewer than 65,536 entries)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids need more than 16 bits")
        #: Each id's length in bytes: a byte-level token has one character a byte.
        self.width = np.zeros(65_536, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.memory: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}

    def _learn(self, pieces: list[str], to: dict[str, bytes]) -> None:
        """Encodes new pieces into ``to``, many in one call. A piece that begins with a space can follow any other that ends in a
        non-space; one that begins with a non-space can follow a line end, which is a token of its own there."""
        glued, lines, alone = [], [], []
        for p in pieces:
            (lines if not p[0].isspace() else glued if p[0] == " " and len(p) > 1 else alone).append(p)
        self._learn_glued(glued, "", to)
        self._learn_glued(lines, "\n", to)
        for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            to[p] = np.array(e.ids, "<u2").tobytes()

    def _learn_glued(self, pieces: list[str], before: str, to: dict[str, bytes]) -> None:
        """Encodes pieces one after another, ``before`` (a token of its own or nothing) in front of each."""
        groups = [pieces[a : a + GLUED] for a in range(0, len(pieces), GLUED)]
        texts = [before + before.join(g) for g in groups]
        skip = len(before)
        for some, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u2")
            ends = np.cumsum(self.width[ids])
            want = np.cumsum([(len(p) if p.isascii() else len(p.encode())) + skip for p in some])
            cuts = np.searchsorted(ends, want)
            first = np.concatenate([[0], cuts[:-1] + 1])
            if ends[-1] != want[-1] or not np.array_equal(ends[cuts], want) or (skip and not (self.width[ids[first]] == skip).all()):
                for p in some:
                    to[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u2").tobytes()
                continue
            raw = ids.tobytes()
            to.update(zip(some, [raw[a:b] for a, b in zip((2 * (first + skip)).tolist(), (2 * cuts + 2).tolist())]))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 16-bit integers. A special token's string is ordinary text."""
        return self._encode_run([text])[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode`` of each text in turn. The new pieces of TOGETHER characters of texts are encoded together."""
        run, size = [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._encode_run(run)
                run, size = [], 0
        yield from self._encode_run(run)

    def _encode_run(self, texts: list[str]) -> list[bytes]:
        if len(self.memory) > CACHE_PIECES:
            self.last, self.memory = self.memory, {}
        found, marks = pieces_of(texts)
        found = found.dictionary_encode()
        pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = list(map(self.memory.get, pieces))
        if new := [p for p, ids in zip(pieces, own) if ids is None]:
            fresh = dict(zip(new, map(self.last.get, new)))
            self._learn([p for p, ids in fresh.items() if ids is None], fresh)
            self.memory.update(fresh)
            own = [fresh[p] if ids is None else ids for p, ids in zip(pieces, own)]
        _, ends, raw = pa.array(own, pa.binary()).take(found.indices).buffers()
        ends = np.frombuffer(ends, np.int32)
        return [raw[a:b].to_pybytes() for a, b in zip(ends[marks[:-1] + 1].tolist(), ends[marks[1:]].tolist())]


@functools.cache
def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer: tasks that follow each other in a worker share its memory."""
    return Encoder(path)


def forget() -> None:
    """Lets go of the process's encoders. Spark's workers outlive a stage, so work of another kind begins with this."""
    encoder.cache_clear()
