"""Language identification in two steps: the family, then pairwise linear support vector machines within it.

A text's inputs are the rates of its letter n-grams (1 to 3 bytes of lower-cased UTF-8, hashed to ``PLACES``), each n
scaled alike. One linear machine a family, each against the rest, picks the family; within it one machine for each pair
of languages votes. All machines are fitted on a bounded sample of documents whose language is given; what is broadcast
is their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.base import crc_mod, free_name, materialise

SAMPLE = 4_000
#: Of one language at most this many rows of the sample.
PER_LANGUAGE = 1_000
PLACES = 1 << 12
NGRAMS = (1, 2, 3)
EPOCHS = 12
UNKNOWN = "und"

# Families of languages by their ISO 639-1 codes. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn mr ne pa gu ur si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_KEEP = np.zeros(256, bool)
_KEEP[0x61:0x7B] = True
_KEEP[0x80:] = True


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def grams(text: bytes) -> list[np.ndarray]:
    """Places of the n-grams, a list for each n; runs of anything but letters are one gap."""
    b = _LOWER[np.frombuffer(text, np.uint8)]
    keep = _KEEP[b]
    b = np.where(keep, b, 32).astype(np.uint32)
    if len(b) > 1:
        b = b[np.concatenate([[True], keep[1:] | keep[:-1]])]
    out = []
    for n in NGRAMS:
        if len(b) < n:
            out.append(np.zeros(0, np.uint32))
            continue
        h = b[: len(b) - n + 1] + np.uint32(n << 24)
        for j in range(1, n):
            h = h * np.uint32(257) + b[j : len(b) - n + 1 + j]
        h = h * np.uint32(0x9E3779B1)
        out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - 12))
    return out


def rates(text: bytes) -> np.ndarray:
    """Inputs: the n-grams' rates, each n of length 1, then all of length 1."""
    out = np.zeros(PLACES, np.float32)
    for g in grams(text):
        if len(g):
            c = np.bincount(g, minlength=PLACES).astype(np.float32)
            out += c / np.linalg.norm(c)
    return out / max(1e-9, float(np.linalg.norm(out)))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def machine(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge) by coordinate steps in the dual; y is 1 or -1. Classes weigh alike."""
    r, n = np.random.default_rng(0), len(y)
    share = (y > 0).mean()
    c = np.where(y > 0, cost / max(share, 1e-6), cost / max(1 - share, 1e-6)) * 5
    alpha, w, b = np.zeros(n), np.zeros(x.shape[1], np.float32), 0.0
    q = np.einsum("ij,ij->i", x, x) + 1 + 0.5 / c
    for _ in range(EPOCHS):
        for i in r.permutation(n):
            g = y[i] * (float(x[i] @ w) + b) - 1 + 0.5 / c[i] * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                b += step
                alpha[i] = new
    return w, b


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]
    weights: np.ndarray  # machines of the families, then of the pairs
    biases: np.ndarray
    pairs: list[list[tuple[int, int, int]]]  # for each family: machine, its language if positive, if negative

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.families:
            return UNKNOWN, 0.0
        z = self.weights @ rates(text.encode()) + self.biases
        f = int(z[: len(self.families)].argmax()) if len(self.families) > 1 else 0
        top = 1.0
        if len(self.families) > 1:
            e = np.exp(3 * (z[: len(self.families)] - z[f]))
            top = float(1 / e.sum())
        votes, margins = np.zeros(len(self.members[f])), np.zeros(len(self.members[f]))
        for k, a, b in self.pairs[f]:
            p = 1 / (1 + np.exp(-3 * float(np.clip(z[k], -20, 20))))
            votes[a if z[k] >= 0 else b] += 1
            margins[a] += p
            margins[b] += 1 - p
        best = int(np.lexsort((margins, votes))[-1])
        inner = margins[best] / (len(margins) - 1) if len(margins) > 1 else 1.0
        return self.members[f][best], top * float(inner)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    langs = np.array(langs, object)
    by: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        by.setdefault(family_of(lang), []).append(lang)
    families, members = list(by), list(by.values())
    found = []
    if len(families) > 1:
        own = np.array([family_of(v) for v in langs], object)
        found = [machine(x, np.where(own == f, 1, -1)) for f in families]
    pairs = []
    for m in members:
        pairs.append([])
        for a, b in combinations(range(len(m)), 2):
            rows = np.flatnonzero((langs == m[a]) | (langs == m[b]))
            pairs[-1].append((len(found), a, b))
            found.append(machine(x[rows], np.where(langs[rows] == m[a], 1, -1)))
    w = np.array([f[0] for f in found], np.float32).reshape(-1, PLACES)
    return Model(families, members, w, np.array([f[1] for f in found], float), pairs)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [has_letter(t) for t in b["text"]]
        b = b[keep]
        yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "x": [rates(t.encode()).astype("<f2").tobytes() for t in b["text"]]})


def train(docs: DataFrame, fold: Column, sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on documents of a fold (a condition on doc_id) with a language: ``sample`` rows at most, and of one language
    ``per_language``, chosen by a hash of the id; each language's first rows come before any's second, so that all have
    some while there are no more languages than ``sample``, beyond which the rarest are left out. An id with two languages counts for the least. Null ids, texts
    and languages are left out; an empty language is one as others are. Without any, every text is ``und``.
    """
    usable = docs.select("doc_id", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & fold)
    # of a frequent language only about twice as many rows as it may have, by the hash that orders them, are dealt by language
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    share = F.xxhash64("doc_id") / 2.0**64 + 0.5
    few = usable.join(F.broadcast(counts), "lang").filter(share * F.col("n") < 2 * per_language + 100).select("doc_id", "lang").distinct()
    ranked = few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("n") <= per_language)
    chosen = ranked.orderBy("n", F.xxhash64("doc_id"), "doc_id", "lang").limit(sample).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    chosen = materialise(chosen, "languages")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    pdf = rows.mapInPandas(_read, "doc_id long, lang string, x binary").toPandas().sort_values("doc_id")
    x = np.array([np.frombuffer(v, "<f2") for v in pdf["x"]], np.float32).reshape(-1, PLACES)
    return fit(x, pdf["lang"].tolist())


def annotate(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with a column of lang_pred and score, whose name is returned. Null texts and those without a letter are
    ``und`` with score 0. A tie of votes goes to the larger margins, then to the last language by name."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for texts in batches:
            got = [m.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    name = free_name(docs, "_language")
    return docs.withColumn(name, predict.asNondeterministic()(F.col("text"))), name


def training_fold(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) != 2


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document, null ids (never held out) and repeated rows too."""
    model = train(docs, training_fold(F.col("doc_id")))
    out, s = annotate(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), F.col(f"{s}.lang_pred").alias("lang_pred"), F.col(f"{s}.score").alias("score"))
