"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's inputs are its distinct words hashed to ``WORDS`` places (with a weight that keeps long texts from
outweighing the rest), one place for the bin of each structure statistic, and one for the bin of its stored length. Pairs
of inputs interact through vectors of ``RANK`` numbers; all pairs are summed in linear time as half of (square of the sum
less sum of the squares). Fitted on a bounded sample of labelled rows; the model broadcast is of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import WordHash, crc_mod, free_name, labelled_sample, materialise, utf8

SAMPLE = 16_000
WORDS = 1 << 14
BINS = 24
RANK = 8
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.02, 1e-4
#: Share of the weight of all words together, beside the statistics' places of weight 1 each.
WORD_WEIGHT = 1.5

STATISTICS = (
    "words", "word_length", "capitals", "symbols", "exclaim", "bars", "digits", "repeated_lines", "distinct", "top_word",
    "runs", "repeated_runs", "beyond_ascii", "stops", "line_words",
)
PLACES = WORDS + (len(STATISTICS) + 1) * BINS
_UPPER = bytes(range(0x41, 0x5B))
_SYMBOLS = b"#*$%&<>"
_DIGITS = b"0123456789"
_ASCII = bytes(range(128))


def _binned(rate: float) -> int:
    """Bin of a rate: a few to a factor of two, from about 1 / 1000."""
    return min(BINS - 1, int(2.2 * np.log2(1 + 1000 * max(0.0, rate))))


def statistics(text: bytes, words: list[bytes], hashed: np.ndarray) -> list[int]:
    """A bin for each of STATISTICS."""
    n, size = max(1, len(words)), max(1, len(text))
    count = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip()]
    _, times = np.unique(hashed, return_counts=True)
    runs = int((hashed[1:] == hashed[:-1]).sum())
    if len(hashed) >= 3:
        with np.errstate(over="ignore"):
            grams = hashed[:-2] * np.uint64(3) + hashed[1:-1] * np.uint64(5) + hashed[2:] * np.uint64(7)
        repeated = 1 - len(np.unique(grams)) / len(grams)
    else:
        repeated = 0.0
    rates = (
        sum(map(len, words)) / n / 40, count(_UPPER) / size, count(_SYMBOLS) / n, text.count(b"!") / n, text.count(b"|") / n, count(_DIGITS) / size,
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(times) / n, (times.max() if len(times) else 0) / n,
        runs / n, repeated, len(text.translate(None, _ASCII)) / size, (text.count(b".") + text.count(b",")) / n, min(1.0, len(lines) / n),
    )
    return [min(BINS - 1, int(2 * np.log2(1 + len(words)))), *map(_binned, rates)]


def inputs(text: bytes, n_chars: int | None, cache: WordHash) -> np.ndarray:
    """Places of a document, its words' first; how many those are is told by the value (below WORDS)."""
    words = text.split()
    hashed = cache.of([w.lower() for w in words])
    bins = statistics(text, words, hashed)
    bins.append(0 if n_chars is None or n_chars < 0 else min(BINS - 1, 1 + int(1.5 * np.log2(1 + n_chars))))
    return np.concatenate([np.unique(hashed >> np.uint64(50)).astype(np.int64), WORDS + BINS * np.arange(len(bins)) + np.array(bins)])


def weights(places: np.ndarray) -> np.ndarray:
    n = int((places < WORDS).sum())
    out = np.ones(len(places))
    if n:
        out[:n] = WORD_WEIGHT / np.sqrt(n)
    return out


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, places: np.ndarray) -> float:
        x = weights(places)
        v = self.factors[places] * x[:, None]
        s = v.sum(0)
        return float(self.bias + self.linear[places] @ x + 0.5 * (s @ s - (v * v).sum()))


def fit(rows: list[np.ndarray], y: np.ndarray) -> Machine:
    """Logistic loss, steps scaled by past gradients, classes weighed alike, the average of the last half of the epochs."""
    r = np.random.default_rng(3)
    w, v, bias = np.zeros(PLACES), r.normal(0, 0.01, (PLACES, RANK)), 0.0
    if not len(y) or y.min() == y.max():
        return Machine(3.0 if not len(y) or y.min() else -3.0, w.astype("f4"), np.zeros((PLACES, RANK), "f4"))
    gw, gv, gb = np.full(PLACES, 1e-2), np.full((PLACES, RANK), 1e-2), 1e-2
    each = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    sizes = np.array([len(p) for p in rows])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    places, x = np.concatenate(rows), np.concatenate([weights(p) for p in rows])
    mean_w, mean_v, mean_b, k = np.zeros_like(w), np.zeros_like(v), 0.0, 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(y))
        for a in range(0, len(y), BATCH):
            own = order[a : a + BATCH]
            at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in own])
            doc = np.repeat(np.arange(len(own)), sizes[own])
            p, xs = places[at], x[at]
            vx = v[p] * xs[:, None]
            s = np.stack([np.bincount(doc, vx[:, f], len(own)) for f in range(RANK)], 1)
            m = bias + np.bincount(doc, w[p] * xs + -0.5 * (vx * vx).sum(1), len(own)) + 0.5 * (s * s).sum(1)
            g = (1 / (1 + np.exp(-m)) - y[own]) * each[own]
            e = g[doc] * xs
            u, back = np.unique(p, return_inverse=True)
            dw = np.bincount(back, e) + DECAY * w[u]
            dv = np.stack([np.bincount(back, e * (s[doc, f] - vx[:, f])) for f in range(RANK)], 1) + DECAY * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            gb += g.sum() ** 2
            w[u] -= 5 * RATE * dw / np.sqrt(gw[u])
            v[u] -= RATE * dv / np.sqrt(gv[u])
            bias -= 5 * RATE * g.sum() / np.sqrt(gb)
        if epoch >= EPOCHS // 2:
            mean_w, mean_v, mean_b, k = mean_w + w, mean_v + v, mean_b + bias, k + 1
    return Machine(mean_b / k, (mean_w / k).astype("f4"), (mean_v / k).astype("f4"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = WordHash()
    for b in batches:
        chars = [None if pd.isna(c) else int(c) for c in b["n_chars"]]
        x = [inputs(bytes(t or b""), c, cache).astype("<u4").tobytes() for t, c in zip(b["text"], chars)]
        yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": x})


def _metadata(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, fold: Column, sample: int = SAMPLE) -> Machine:
    """Fits on labelled documents of a fold (a condition on the labels' doc_id), ``sample`` rows at most.

    With one class only the machine says that class always, without labels 1.
    """
    rows = labelled_sample(docs, labels, "quality", fold, sample, _metadata(docs).alias("n_chars"))
    rows = materialise(rows.select("doc_id", "y", utf8(F.col("text")).alias("text"), "n_chars"), "quality")
    pdf = rows.mapInPandas(_read, "doc_id long, y int, x binary").toPandas().sort_values("doc_id")
    return fit([np.frombuffer(v, "<u4").astype(np.int64) for v in pdf["x"]], (pdf["y"].to_numpy() > 0).astype(float))


def annotate(docs: DataFrame, machine: Machine) -> tuple[DataFrame, str]:
    """``docs`` with a column of scores, whose name is returned; null and empty texts have statistics but no words."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m, cache = held.value, WordHash()
        for texts, chars in batches:
            z = np.array([m.margin(inputs(t.as_py() or b"", c, cache)) for t, c in zip(texts, chars.to_pylist())])
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())

    name = free_name(docs, "_quality")
    return docs.withColumn(name, score.asNondeterministic()(utf8(F.col("text")), _metadata(docs))), name


def training_fold(doc_id: Column) -> Column:
    return crc_mod(doc_id, 3) != 1


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    machine = train(docs, labels, training_fold(F.col("doc_id")))
    out, s = annotate(docs.select("doc_id", "text", *["n_chars"] * ("n_chars" in docs.columns)), machine)
    return out.select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), F.col(s).alias("score"), (F.col(s) >= 0.5).cast("int").alias("predicted"))
