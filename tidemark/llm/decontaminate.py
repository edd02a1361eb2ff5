"""Benchmark decontamination by winnowing.

Training and test texts are cut into words, each run of ``K`` words is hashed, and in every window of ``WINDOW``
consecutive run hashes the smallest is kept as a fingerprint. Two texts that share ``SPAN = K + WINDOW - 1`` words keep
the same fingerprint inside the shared words, so a join on fingerprints meets every shared span of that length. Each
meeting is extended to the spans of ``SPAN`` words around it that the benchmark holds; overlapping ones grow to the whole
shared passage. Items of fewer words are one window as a whole, met through the hash of all their words. Equal windows
of the benchmark are held once with the items that have them, so that the work is in proportion to the words of a
text, however often words repeat.

The fingerprints of the benchmark are broadcast in blocks of at most ``BLOCK_BYTES`` of item text; a larger benchmark
takes several passes over the documents, with the state of a row carried from pass to pass in a written table.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import WordHash, free_name, gram_hashes, materialise, odd_numbers, utf8

SPAN = 13
K = 7
WINDOW = SPAN - K + 1
BLOCK_BYTES = 16_000_000
#: A document is contaminated if SHARE times its hit words reach its words.
SHARE = 20

_MULTIPLIERS = odd_numbers(K, 9)
_TO_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256)
)
#: n_words, the hit spans as pairs of 32-bit word positions, their words, the ids met and their digest.
STATE = "struct<n_words:bigint,spans:binary,n_hit:bigint,items:array<string>,items_sha256:string>"
_STATE = pa.struct([("n_words", pa.int64()), ("spans", pa.binary()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("items_sha256", pa.string())])


def words_of(text: bytes) -> list[bytes]:
    """Words of ASCII letters (lower-cased), digits and anything beyond ASCII."""
    return text.translate(_TO_WORDS).split()


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` of every ``n`` consecutive values; the result is n - 1 shorter."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept runs; all positions that share a window's minimum are kept."""
    h = gram_hashes(words, K, _MULTIPLIERS)
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _slide(h, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(h == _slide(np.concatenate([edge, low, edge]), WINDOW, np.maximum))
    return at, h[at]


class Windows:
    """The distinct runs of ``n`` words of some items, by hash, with the items that hold each."""

    def __init__(self, n: int, items: list[tuple[int, np.ndarray]]):
        self.n, self.words = n, np.concatenate([w for _, w in items])
        sizes = np.array([len(w) - n + 1 for _, w in items])
        begins = np.cumsum([0, *(len(w) for _, w in items[:-1])])
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
        for seed in range(9, 1000):
            # other multipliers where two different runs would share a hash
            self.multipliers = odd_numbers(SPAN, seed)
            h = gram_hashes(self.words, n, self.multipliers)[at]
            self.keys, first, which = np.unique(h, return_index=True, return_inverse=True)
            self.at = at[first]
            if all(np.array_equal(self.words[at + j], self.words[self.at[which] + j]) for j in range(n)):
                break
        pairs = np.unique(np.stack([which, np.repeat([k for k, _ in items], sizes)], 1), axis=0)
        self.items = pairs[:, 1]
        self.ends = np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1))

    def met(self, words: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``words`` (of ``places``, or all) where a run begins that is among these, and its number."""
        h = gram_hashes(words, self.n, self.multipliers)
        places = np.arange(len(h)) if places is None else places
        which = np.minimum(np.searchsorted(self.keys, h[places]), len(self.keys) - 1)
        ok = self.keys[which] == h[places]
        places, which = places[ok], which[ok]
        same = np.ones(len(places), bool)
        for j in range(self.n):
            same &= words[places + j] == self.words[self.at[which] + j]
        return places[same], which[same]

    def holders(self, which: np.ndarray) -> np.ndarray:
        """The items of some runs."""
        which = np.unique(which)
        return np.unique(np.concatenate([self.items[self.ends[k] : self.ends[k + 1]] for k in which.tolist()]))


class Block:
    """Part of the benchmark: the fingerprints and windows of long items, and the windows of short ones."""

    def __init__(self, items: list[tuple[str, bytes]]):
        cache, by_size = WordHash(), defaultdict(list)
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            w = cache.of(words_of(text))
            if len(w):
                by_size[min(len(w), SPAN)].append((k, w))
        self.windows = [Windows(n, own) for n, own in sorted(by_size.items())]
        kept = [fingerprints(w)[1] for _, w in by_size.get(SPAN, [])]
        self.fingerprints = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)


def find(words: np.ndarray, starts: np.ndarray, block: Block) -> dict[int, tuple[list[tuple[int, int]], set[int]]]:
    """Hits of the documents whose hashed words follow each other in ``words``, from ``starts[i]`` to ``starts[i + 1]``.

    Returns, for documents with hits, spans (within the document) and the numbers of the items met.
    """
    marks, met = np.zeros(len(words) + 1, np.int64), []
    for w in block.windows:
        if len(words) < w.n:
            continue
        near = None
        if w.n == SPAN:
            at, h = fingerprints(words)
            known = np.minimum(np.searchsorted(block.fingerprints, h), len(block.fingerprints) - 1)
            at = at[block.fingerprints[known] == h]
            near = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
            near = near[(near >= 0) & (near <= len(words) - SPAN)]
        places, which = w.met(words, near)
        d = np.searchsorted(starts, places, side="right") - 1
        inside = places + w.n <= starts[d + 1]
        places, which, d = places[inside], which[inside], d[inside]
        np.add.at(marks, places, 1)
        np.add.at(marks, places + w.n, -1)
        met += [(d[a:b], w, which[a:b]) for a, b in zip(*_runs(d))]
    covered = np.cumsum(marks) > 0
    found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
    for d, w, which in met:
        k = int(d[0])
        if k not in found:
            own = np.diff(np.concatenate([[0], covered[starts[k] : starts[k + 1]].astype(np.int8), [0]]))
            found[k] = (list(zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist())), set())
        found[k][1].update(w.holders(which).tolist())
    return found


def _runs(d: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of equal values."""
    cuts = (np.flatnonzero(np.diff(d)) + 1).tolist()
    return ([0, *cuts], [*cuts, len(d)]) if len(d) else ([], [])


def _joined(spans: np.ndarray) -> np.ndarray:
    """Sorted spans without overlaps."""
    out: list[list[int]] = []
    for a, b in spans[np.lexsort((spans[:, 1], spans[:, 0]))].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.uint32).reshape(-1, 2)


def _pass(block_of):
    @F.arrow_udf(STATE)
    def meet(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        cache, block = WordHash(), block_of.value
        for texts, before in batches:
            old = before.to_pylist()
            counts, parts, out = [], [], []
            lines = texts.to_pylist()
            first = 0
            while first < len(lines):
                counts, parts, size, last = [], [], 0, first
                while last < len(lines) and (size < 400_000 or last == first):
                    w = words_of(lines[last] or b"")
                    counts.append(len(w))
                    parts.append(cache.of(w))
                    size += len(w)
                    last += 1
                starts = np.concatenate([[0], np.cumsum(counts)])
                found = find(np.concatenate(parts), starts, block)
                for i in range(last - first):
                    was = old[first + i] or {"spans": b"", "items": []}
                    spans, items = found.get(i, ([], ()))
                    if spans and was["spans"]:
                        spans = spans + np.frombuffer(was["spans"], np.uint32).reshape(-1, 2).tolist()
                    packed = _joined(np.array(spans, np.int64)) if spans else np.frombuffer(was["spans"], np.uint32).reshape(-1, 2)
                    ids = sorted({*was["items"], *(block.ids[k] for k in items)})
                    n_hit = int((packed[:, 1].astype(np.int64) - packed[:, 0]).sum())
                    digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
                    out.append({"n_words": counts[i], "spans": packed.tobytes(), "n_hit": n_hit, "items": ids, "items_sha256": digest})
                first = last
            yield pa.array(out, _STATE)

    return meet.asNondeterministic()


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in lists of at most ``block_bytes`` of text (one item at least), read a partition at a time."""
    rows, size = [], 0
    of = benchmark.select(F.col("item_id").cast("string").alias("i"), utf8(F.col("text")).alias("t"))
    for r in of.filter("i is not null and t is not null").toLocalIterator():
        rows.append((r.i, bytes(r.t)))
        size += len(r.t)
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def annotate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: a struct of n_words, n_hit, items, spans, items_sha256
    and contaminated.

    ``spans`` holds the hit words as pairs of little-endian 32-bit positions, end exclusive. A null or empty text has no
    words and no hit and isn't contaminated; null items and items without words are met by nothing; items that repeat an
    id count once; repeated documents are judged each. No document or item at all gives an empty or a clean result.
    """
    spark = docs.sparkSession
    state = free_name(docs, "_met")
    out = docs.withColumn(state, F.lit(None).cast(STATE))
    last = None
    for items in blocks_of(benchmark, block_bytes):
        if last is not None:
            out = materialise(out, "decontaminate")
            last.destroy()
        last = spark.sparkContext.broadcast(Block(items))
        out = out.withColumn(state, _pass(last)(utf8(F.col("text")), F.col(state)))
    if last is None:
        out = out.withColumn(state, _pass(spark.sparkContext.broadcast(Block([])))(utf8(F.col("text")), F.col(state)))
    n_hit, n_words = F.col(f"{state}.n_hit"), F.col(f"{state}.n_words")
    return out.withColumn(state, F.col(state).withField("contaminated", (n_hit > 0) & (n_hit * SHARE >= n_words))), state


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; columns as they were."""
    out, state = annotate(docs, benchmark)
    return out.filter(~F.col(f"{state}.contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    out, state = annotate(docs.select("doc_id", "text"), benchmark)
    s = F.col(state)
    return out.select(
        "doc_id",
        s["n_words"].alias("n_words"),
        s["n_hit"].alias("n_hit"),
        F.size(s["items"]).cast("long").alias("n_items"),
        s["items_sha256"].alias("items_sha256"),
        s["contaminated"].alias("contaminated"),
    )
