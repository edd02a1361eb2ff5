"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates of a whole text: densities of a lexicon of words and of word stems (both learned from the training
fold by a log-likelihood test, beside a small built-in list of insults), how close its hits stand to the second person,
capitals, punctuation, and spellings that hide letters. All are fitted on a bounded sample of labelled rows in two halves:
a row's features come from the other half's lexicon, and the margin by which it takes part in the calibration from trees
grown on the other half. What is broadcast is the model, whose size its parameters bound.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import CACHE_WORDS, crc_mod, free_name, labelled_sample, materialise, utf8
from tidemark.llm.tokens import forget

#: Labelled rows that the model is fitted on at most.
SAMPLE = 24_000
LEXICON = 4_000
STEMS = (4, 5, 6)
#: Log-likelihood ratio from which a word counts as a sign of toxicity.
EVIDENCE = 25.0
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 12
#: Documents that hold a term, by half and label.
COUNTS = ("neg0", "pos0", "neg1", "pos1")

# Insults and second persons of the languages at hand.
INSULTS = "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown dumb imbecile jerk bastard idiota imbécil estúpido basura asqueroso payaso idiote crétin imbécile ordure minable dégoûtant salaud dumm blöd abschaum ekelhaft trottel versager"
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes vosotros ti tú"
FEATURES = (
    "words", "insult", "insult_rate", "lexicon", "lexicon_rate", "stem", "stem_rate", "near_you", "you_rate",
    "caps_words", "caps_letters", "exclaim", "question", "punctuation", "digits", "hidden", "stretched", "best_window",
)

_WORD = re.compile(rb"[^\x00-\x26\x28-\x2f\x3a-\x3f\x5b-\x60\x7b-\x7f]+")
_LETTERS = bytes(range(0x61, 0x7B))
_HIDE = bytes.maketrans(b"013457@$!", b"oieastasi")
#: Whole runs of letters and signs that hold a sign.
_SIGNED = re.compile(rb"(?<![a-z0-9@$*!\x80-\xff])[a-z\x80-\xff]*+[0-9@$*!][a-z0-9@$*!\x80-\xff]*+")
_SIGN = re.compile(rb"[0-9@$*!]")
_LETTER = re.compile(rb"[a-z]")
_HIDDEN = re.compile(rb"[a-z][a-z0-9@$*!]+[a-z]")
_ANY = rb"(?:[a-z]|[\xc3-\xf4][\x80-\xbf]+)"
#: Longer runs of letters and signs are not looked up.
LONGEST = 40
_STRETCHED = re.compile(rb"([a-z])\1\1")


#: What a word is: bits of its number in ``WordSigns``.
SECOND, INSULT, LEXICAL, STEM, CAPS, DIGITS, STRETCH = (1 << k for k in range(7))


class Remembered(dict):
    """word -> ``of(word)``, remembered for the words seen lately."""

    def __init__(self, of: Callable[[bytes], int]):
        self.of = of

    def __missing__(self, word: bytes) -> int:
        v = self.of(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = v
        return v


class WordSigns(Remembered):
    """The bits of words as they are written."""

    def __init__(self, lexicon: Lexicon):
        super().__init__(self.look)
        self.lexicon = lexicon

    def look(self, raw: bytes) -> int:
        lexicon, w = self.lexicon, raw.lower()
        v = STRETCH if _STRETCHED.search(w) else 0
        if w in lexicon.words:
            v |= LEXICAL
        elif w[:4] in lexicon.stems or w[:5] in lexicon.stems or w[:6] in lexicon.stems:
            v |= STEM
        if w in lexicon.insults:
            v |= INSULT
        if w in lexicon.second:
            v |= SECOND
        if w == raw:
            return v | DIGITS if raw.isdigit() else v
        return v | CAPS if len(raw) > 1 and raw.isupper() else v


@dataclass
class Lexicon:
    words: frozenset[bytes] = frozenset()
    stems: frozenset[bytes] = frozenset()
    insults: frozenset[bytes] = field(default_factory=lambda: frozenset(w.encode() for w in INSULTS.split()))
    second: frozenset[bytes] = field(default_factory=lambda: frozenset(w.encode() for w in SECOND_PERSON.split()))

    @cached_property
    def signs(self) -> WordSigns:
        return WordSigns(self)

    @cached_property
    def concealed(self) -> Remembered:
        return Remembered(self.conceals)

    def conceals(self, w: bytes) -> bool:
        """Whether signs and digits of ``w`` stand for letters of an insult or a word of the lexicon; a star is any one
        letter, or put in. Not where what is between the signs is such a word anyway."""
        if len(w) > LONGEST or not _LETTER.search(w) or any(x in self.insults or x in self.words for x in _WORD.findall(w)):
            return False
        w = w.rstrip(b"!").translate(_HIDE)
        plain = w.replace(b"*", b"")
        if plain in self.insults or plain in self.words:
            return True
        if b"*" not in w or len(plain) < max(2, len(w) - len(plain)):
            return False
        return re.search(b"(?m)^" + _ANY.join(re.escape(x) for x in w.split(b"*")) + b"$", self.listed) is not None

    @cached_property
    def listed(self) -> bytes:
        return b"\n".join(sorted(self.insults | self.words))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words. Signs that stand in for letters are looked at apart, so that 'idiot!you' stays two words."""
    return _WORD.findall(text.lower())


def features(text: bytes, lexicon: Lexicon) -> np.ndarray:
    signs = lexicon.signs
    is_a = np.fromiter(map(signs.__getitem__, _WORD.findall(text)), np.uint8)
    n = len(is_a)
    out = np.zeros(len(FEATURES))
    if not n:
        out[11] = text.count(b"!")
        return out
    count = lambda bit: int(np.count_nonzero(is_a & bit))
    insult, lexical, stem = count(INSULT), count(LEXICAL), count(STEM)
    at, own = np.flatnonzero(is_a & SECOND), np.flatnonzero(is_a & (INSULT | LEXICAL | STEM))
    odd = 0
    for w in _SIGNED.findall(text.lower()):
        concealed = lexicon.concealed[w]
        insult += concealed
        bare = w.strip(b"*!")
        odd += concealed or bool(_SIGN.search(bare) and _HIDDEN.fullmatch(bare))
    near = 0
    if len(at) and len(own):
        j = np.searchsorted(at, own)
        gap = np.minimum(np.abs(own - at[np.minimum(j, len(at) - 1)]), np.abs(own - at[np.maximum(j - 1, 0)]))
        near = int((gap <= 5).sum())
    best = 0
    if len(own):
        best = int((np.searchsorted(own, own + 50) - np.arange(len(own))).max())
    letters = len(text) - len(text.translate(None, _LETTERS + _LETTERS.upper()))
    upper = len(text) - len(text.translate(None, _LETTERS.upper()))
    marks = len(text) - len(text.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"))
    out[:] = (
        np.log1p(n), insult, insult / n, lexical, lexical / n, stem, stem / n, near, len(at) / n,
        count(CAPS) / n, upper / max(1, letters), text.count(b"!") / n, text.count(b"?") / n, marks / n,
        count(DIGITS) / n, odd / n, count(STRETCH) / n, best,
    )
    return out


def learn_lexicon(counts: DataFrame, pos: Column, neg: Column, positives: int, negatives: int) -> Lexicon:
    """counts: term, and ``pos`` and ``neg`` documents that hold it. Keeps the LEXICON terms with most evidence at most;
    those with equal evidence in the order of the terms."""
    p, n = pos.cast("double"), neg.cast("double")
    total, share = p + n, positives / max(1, positives + negatives)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    evidence = 2 * (part(p, total * share) + part(n, total * (1 - share)))
    kept = counts.filter((p > 2 * share * total) & (p > 4 * n)).withColumn("e", evidence).filter(F.col("e") >= EVIDENCE)
    terms = [bytes(r.term) for r in kept.orderBy(F.desc("e"), "term").limit(LEXICON).collect()]
    return Lexicon(frozenset(t[1:] for t in terms if t[:1] == b"w"), frozenset(t[1:] for t in terms if t[:1] == b"s"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and stems of the documents of a task, by half and label."""
    forget()
    counts: dict[bytes, list[int]] = {}

    def emit() -> pa.RecordBatch:
        own = np.array(list(counts.values()), np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.binary())} | {c: pa.array(own[:, k]) for k, c in enumerate(COUNTS)})

    for batch in batches:
        for half, y, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = set(words_of(text or b""))
            at = 2 * half + (1 if y else 0)
            for t in {b"w" + w for w in words} | {b"s" + w[:k] for w in words for k in STEMS if len(w) > k}:
                counts.setdefault(t, [0] * 4)[at] += 1
            if len(counts) > 400_000:
                yield emit()
                counts.clear()
    if counts:
        yield emit()


@dataclass
class Trees:
    """Boosted trees of fixed depth: a split for each inner node, a value for each leaf."""

    edges: list[np.ndarray]
    splits: np.ndarray  # tree, node -> feature, bin
    leaves: np.ndarray  # tree, leaf
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.bins(x), np.full(len(x), self.base), np.arange(len(x))
        for s, v in zip(self.splits, self.leaves):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, s[node, 0]] > s[node, 1])
            out += v[node - (2**DEPTH - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss over histograms of at most BINS values a feature."""
    edges = []
    for k in range(x.shape[1]):
        u = np.unique(x[:, k])
        edges.append(u[:-1] if len(u) <= BINS else np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])))
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    trees = Trees(edges, np.zeros((0, 2**DEPTH - 1, 2), int), np.zeros((0, 2**DEPTH)), float(np.log(share / (1 - share))))
    b, f = trees.bins(x), np.full(len(x), trees.base)
    splits, leaves, width = [], [], BINS + 1
    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node, own = np.zeros(len(x), int), np.zeros((2**DEPTH - 1, 2), int)
        own[:, 1] = width  # no split: all go left
        for level in range(DEPTH):
            first = 2**level - 1
            for q in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == q)
                if len(rows) >= 2 * LEAF:
                    best = 1e-9
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for k in range(x.shape[1]):
                        bk = b[rows, k]
                        gl = np.cumsum(np.bincount(bk, g[rows], width))[:-1]
                        hl = np.cumsum(np.bincount(bk, h[rows], width))[:-1]
                        nl = np.cumsum(np.bincount(bk, minlength=width))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = 0
                        if gain.max() > best:
                            best, own[q] = gain.max(), (k, int(gain.argmax()))
                node[rows] = 2 * q + 1 + (b[rows, own[q, 0]] > own[q, 1])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        f = f + value[leaf]
        splits.append(own)
        leaves.append(value)
    if splits:
        trees.splits, trees.leaves = np.array(splits), np.array(leaves)
    return trees


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve from margins to probabilities (pool adjacent violators), pulled a little towards the mean
    so that no knot is quite 0 or 1."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest and highest margin
    for m, v in zip(margin[order], y[order]):
        blocks.append([float(v), 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            s, w, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = hi
    xs, ys = [], []
    for s, w, lo, hi in blocks:
        p = (s + 0.5 * y.mean()) / (w + 0.5)
        xs += [lo] if lo == hi else [lo, hi]
        ys += [p] if lo == hi else [p, p]
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.trees.margin(x)
        if len(self.knots[0]) < 2:
            return 1 / (1 + np.exp(-m))
        # a small slope keeps apart what one flat part of the curve would tie
        flat = np.interp(m, *self.knots)
        return np.clip(flat + 1e-4 * (1 / (1 + np.exp(-m)) - 0.5), 0, 1)


def _featuriser(of_half: tuple[Lexicon, Lexicon]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [features(bytes(t or b""), of_half[h]).astype("<f4").tobytes() for h, t in zip(b["half"], b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "half": b["half"], "x": x})

    return run


def train(docs: DataFrame, labels: DataFrame, fold: Column, sample: int = SAMPLE) -> Model:
    """Fits on labelled documents of a fold (a condition on the labels' doc_id), ``sample`` rows at most.

    Rows with a null id or label are left out; an id that repeats counts once. Without labels, or with one kind only,
    no tree is grown and every text scores alike, below a half. The halves are dealt by a hash of the id.
    """
    half = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(2)).cast("int").alias("half")
    rows = materialise(labelled_sample(docs, labels, "toxic", fold, sample).select("doc_id", "y", utf8(F.col("text")).alias("text"), half), "toxic")
    n = [[0, 0], [0, 0]]
    for r in rows.groupBy("half", (F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect():  # 4 rows at most
        n[r.half][r.y] = r.n
    terms = rows.select("half", "y", "text").mapInArrow(_terms, "term binary, " + ", ".join(f"{c} long" for c in COUNTS))
    terms = materialise(terms.groupBy("term").agg(*[F.sum(c).alias(c) for c in COUNTS]), "terms")
    first, second = (learn_lexicon(terms, F.col(f"pos{h}"), F.col(f"neg{h}"), n[h][1], n[h][0]) for h in (0, 1))
    lexicon = learn_lexicon(terms, F.col("pos0") + F.col("pos1"), F.col("neg0") + F.col("neg1"), n[0][1] + n[1][1], n[0][0] + n[1][0])
    pdf = rows.mapInPandas(_featuriser((second, first)), "doc_id long, y int, half int, x binary").toPandas().sort_values("doc_id")
    x = np.array([np.frombuffer(v, "<f4") for v in pdf["x"]], float).reshape(-1, len(FEATURES))
    y, half = (pdf["y"].to_numpy() > 0).astype(float), pdf["half"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Model(lexicon, Trees([np.zeros(0)] * len(FEATURES), np.zeros((0, 1, 2), int), np.zeros((0, 1)), -2.0), (np.zeros(0), np.zeros(0)))
    margin = np.zeros(len(y))
    for h in (0, 1):
        margin[half == h] = grow(x[half != h], y[half != h]).margin(x[half == h])
    return Model(lexicon, grow(x, y), isotonic(margin, y))


def annotate(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with a column of scores, whose name is returned: each whole text's, null and empty texts' too."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        m = held.value
        for texts in batches:
            x = np.array([features(t.as_py() or b"", m.lexicon) for t in texts]).reshape(-1, len(FEATURES))
            yield pa.array(m.score(x.astype("<f4").astype(float)), pa.float64())

    name = free_name(docs, "_toxicity")
    return docs.withColumn(name, score.asNondeterministic()(utf8(F.col("text")))), name


def training_fold(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) != 0


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; null ids (crc32 of an empty text decides on their fold) and
    repeated rows are scored each. Equal texts score alike; a score of exactly 0.5 counts as toxic."""
    model = train(docs, labels, training_fold(F.col("doc_id")))
    out, s = annotate(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), F.col(s).alias("score"), (F.col(s) >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; columns as they were."""
    out, s = annotate(docs, train(docs, labels, training_fold(F.col("doc_id"))))
    return out.filter(F.col(s) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
