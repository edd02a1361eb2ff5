"""Hard negatives by a full sort of each anchor's scores.

Vectors become whole numbers, so that scores are exact. Anchors are the stated query set: they go to the tasks in bunches
of at most ``BUNCH_BYTES`` and meet all rows in two passes, a block of rows at a time. In the first pass each anchor's scores over the
rows of its label are sorted, by score and then by id, and the first few of each block are kept; the firsts of all blocks hold the
positives. In the second pass each anchor's scores over a block are sorted whole, the upper and lower limit of each positive are found
in them by binary search, and the first rows of another label from the upper limit on are kept. What tasks keep is
bounded by the bunch, and the firsts of what they kept are the firsts of all rows, so nothing is lost and no row is dealt.

Results for odd rows: a row with a null id, label or vector, or with a null, NaN or infinite component, takes no part. Vectors of
unequal length are filled up with zeros. Rows that repeat an id are rows of their own: each anchor row has its own
results, and a row that repeats an anchor may be its positive. Components beyond a long are held at its limits, and so are scores. No rows, or
no anchors, give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import materialise

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of its positive's.
LOWER, UPPER = 50, 95
ANCHOR_EVERY = 50
#: Bytes of anchors that are sent to the tasks at once; more anchors mean more passes.
BUNCH_BYTES = 16_000_000
#: Rows and anchors whose scores are in memory at once.
ROWS, ANCHORS = 4096, 256
_LONG = np.iinfo(np.int64)

POSITIVE = "anchor long, id long, score long"
NEGATIVE = "anchor long, positive long, id long, score long"


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (array of long): the rows that take part, with floor(scale * x) of each component."""
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.select("vec_id", "label", "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~odd)
    return kept.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix, filled up with zeros."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_pylist()])
    n = np.diff(ends)
    out = np.zeros((len(n), max([width, *n])), np.int64)
    if len(n) and (n == out.shape[1]).all():
        return flat.reshape(out.shape).astype(np.int64)
    for k in range(len(n)):
        out[k, : n[k]] = flat[ends[k] : ends[k + 1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, held at the limits of a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    size = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    most = width * size(a) * size(b)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, _LONG.min, _LONG.max).astype(np.int64)


def ranked(scores: np.ndarray) -> np.ndarray:
    """For each row of scores over columns that ascend by id, the columns by descending score and then by id."""
    return np.argsort(np.where(scores == _LONG.min, _LONG.max, -scores), axis=1, kind="stable")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors of up to ROWS rows, ascending by id."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            yield ids[order], part.column(1).to_numpy(zero_copy_only=False)[order], matrix(part.column(2))[order]


def _firsts(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the first ``k`` by descending score and then by id."""
    return np.lexsort((ids, np.where(scores == _LONG.min, _LONG.max, -scores)))[:k]


def _positives(anchors, k: int):
    """The first ``k`` rows of each anchor's label that a task met, the anchor's own among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, vectors = anchors.value
        own = {y: np.flatnonzero(labels == y) for y in np.unique(labels)}
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for ids, ys, block in _blocks(batches):
            for y in np.intersect1d(ys, labels):
                at = np.flatnonzero(ys == y)
                for begin in range(0, len(own[y]), ANCHORS):
                    who = own[y][begin : begin + ANCHORS]
                    scores = products(vectors[who], block[at])
                    for a, s, order in zip(who.tolist(), scores, ranked(scores)[:, :k]):
                        s, found = s[order], ids[at][order]
                        if a in best:
                            s, found = np.concatenate([best[a][0], s]), np.concatenate([best[a][1], found])
                            first = _firsts(s, found, k)
                            s, found = s[first], found[first]
                        best[a] = s, found
        for a, (s, found) in best.items():
            yield pa.RecordBatch.from_pydict({"anchor": pa.array([a] * len(s), pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(s, pa.int64())})

    return run


def _negatives(anchors, k: int, lower: int, upper: int):
    """The first ``k`` rows of another label within the limits of each anchor and positive that a task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, vectors, limits = anchors.value
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for ids, ys, block in _blocks(batches):
            for begin in range(0, len(labels), ANCHORS):
                scores = products(vectors[begin : begin + ANCHORS], block)
                for a, s, order in zip(range(begin, len(labels)), scores, ranked(scores)):
                    down, other = s[order][::-1], np.flatnonzero(ys[order] != labels[a])
                    for p, score in limits.get(a, ()):
                        most, least = upper * score // 100, -(-lower * score // 100)
                        start = len(down) - np.searchsorted(down, most, "right")
                        end = len(down) - np.searchsorted(down, least, "left")
                        at = np.searchsorted(other, start)
                        got = order[(place := other[at : at + k])[place < end]]
                        if len(got):
                            mine, found = s[got], ids[got]
                            if (a, p) in best:
                                mine, found = np.concatenate([best[a, p][0], mine]), np.concatenate([best[a, p][1], found])
                                first = _firsts(mine, found, k)
                                mine, found = mine[first], found[first]
                            best[a, p] = mine, found
        for (a, p), (s, found) in best.items():
            n = len(s)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array([a] * n, pa.int64()), "positive": pa.array([p] * n, pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(s, pa.int64())})

    return run


def _best(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their rank; Spark cuts to ``k`` before it deals the rows, too."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``anchors``, which are rows of ``rows``
    (both vec_id, label, v as ``whole_vectors`` gives them). Positives are the first ``positives`` other rows of the anchor's label,
    negatives the first ``negatives`` of other labels between ``lower`` and ``upper`` hundredths of the positive's score."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    numbered = materialise(anchors.select("vec_id", "label", "v", F.monotonically_increasing_id().alias("number")), "anchors")
    size = numbered.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    bunches = -(-size["n"] * 8 * max(1, size["width"] or 1) // BUNCH_BYTES)
    out = []
    for b in range(bunches):
        held = numbered.filter(F.pmod("number", F.lit(bunches)) == b).toArrow().combine_chunks()
        ids, labels = held["vec_id"].to_pylist(), held["label"].to_numpy()
        vectors = matrix(held["v"].combine_chunks())
        sent = context.broadcast((labels, vectors))
        near: dict[int, list[tuple[int, int, int]]] = {}
        for r in _best(rows.mapInArrow(_positives(sent, positives + 1), POSITIVE), ["anchor"], positives + 1).collect():
            near.setdefault(r["anchor"], []).append((r["rank"], r["id"], r["score"]))
        chosen = []
        for a, found in near.items():
            found.sort()
            self = (ids[a], int(products(vectors[a : a + 1], vectors[a : a + 1])[0, 0]))
            own = next((k for k, (_, i, s) in enumerate(found) if (i, s) == self), len(found))
            chosen += [(a, p, ids[a], i, s) for p, (_, i, s) in enumerate((found[:own] + found[own + 1 :])[:positives])]
        limits: dict[int, list[tuple[int, int]]] = {}
        for a, p, _, _, s in chosen:
            limits.setdefault(a, []).append((p, s))
        again = context.broadcast((labels, vectors, limits))
        firsts = _best(rows.mapInArrow(_negatives(again, negatives, lower, upper), NEGATIVE), ["anchor", "positive"], negatives)
        named = spark.createDataFrame(chosen, "anchor long, positive long, anchor_id long, positive_id long, positive_score long")
        whole = firsts.join(F.broadcast(named), ["anchor", "positive"])
        out.append(
            materialise(whole.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        )
        sent.destroy()
        again.destroy()
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by ANCHOR_EVERY. Where vec_id is divisible by 7, the label
    becomes (label + 1) % 10 first."""
    rows = whole_vectors(embeddings).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0))
