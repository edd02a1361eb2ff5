"""Packing by patterns of few lengths.

Only the histogram of piece lengths reaches the driver (at most ``capacity`` numbers). All patterns of two kinds that fill
a sequence exactly are enumerated over the lengths that occur: copies of one or of two lengths, and three different
lengths once each. Non-negative least squares fits how often each pattern is used to the histogram; the counts are
rounded and cut to what is there, and the pieces left over are packed best fit, longest first, still by length.

Pieces of one length are alike to a plan, so a piece needs just its rank among those of its length: its rank in its own
task plus the pieces of earlier tasks. Ranks are turned to places by a search in the plan's table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.base import materialise
from tidemark.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
#: Rounds of the fit at most, patterns looked at in a round, and the step in counts below which the fit is done.
ROUNDS, LOOKED_AT, STILL = 300, 4096, 0.05

Plan = list[tuple[tuple[int, ...], int]]


def best_fit(histogram: np.ndarray, capacity: int) -> Plan:
    """Best fit, longest first, all pieces of a length at once. Sequences that look alike are kept as one with a count."""
    open_by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # sorted rooms that have sequences
    for length in range(len(histogram) - 1, 0, -1):
        left = int(histogram[length])
        while left:
            at = int(np.searchsorted(rooms, length)) if rooms else 0
            if at == len(rooms):
                per = capacity // length
                if left >= per:
                    pattern, n = (length,) * per, left // per
                else:
                    pattern, n = (length,) * left, 1
                left -= n * len(pattern)
                room = capacity - length * len(pattern)
            else:
                old_room = rooms[at]
                groups = open_by_room[old_room]
                pattern, n = groups.popitem()
                more = min(old_room // length, left)
                use = min(n, left // more)
                if use < n:
                    groups[pattern] = n - use
                if not groups:
                    del open_by_room[old_room]
                    rooms.pop(at)
                left -= use * more
                pattern, n, room = pattern + (length,) * more, use, old_room - length * more
            if room not in open_by_room:
                open_by_room[room] = {}
                rooms.insert(int(np.searchsorted(rooms, room)), room)
            open_by_room[room][pattern] = open_by_room[room].get(pattern, 0) + n
    return [(p, n) for groups in open_by_room.values() for p, n in groups.items()]


def patterns(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Every pattern that the histogram has pieces for: up to three lengths a row, 0 where there are fewer, and how often
    the pattern holds each. There are at most about capacity squared / 10 of them."""
    lengths = np.flatnonzero(histogram[: capacity + 1])
    lengths = lengths[lengths > 0]
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    most = np.minimum(histogram[lengths], capacity // np.maximum(lengths, 1)).astype(np.int64)
    length, first = np.repeat(lengths, most), np.cumsum(most) - most
    copies = np.arange(most.sum()) - np.repeat(first, most) + 1
    order = np.argsort(length * copies, kind="stable")
    length, copies = length[order], copies[order]
    filled = length * copies
    whole, none = filled == capacity, np.zeros(int((filled == capacity).sum()), np.int64)
    held, times = [np.stack([length[whole], none, none], 1)], [np.stack([copies[whole], none, none], 1)]
    low, high = (np.searchsorted(filled, capacity - filled, side) for side in ("left", "right"))
    i = np.repeat(np.arange(len(filled)), high - low)
    j = np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    i, j = i[length[i] > length[j]], j[length[i] > length[j]]
    none = np.zeros(len(i), np.int64)
    held.append(np.stack([length[i], length[j], none], 1))
    times.append(np.stack([copies[i], copies[j], none], 1))
    for x in lengths.tolist():  # three lengths, x > y > z
        y = lengths[(lengths < x) & (2 * lengths > capacity - x) & (lengths < capacity - x)]
        y = y[there[capacity - x - y]]
        held.append(np.stack([np.full(len(y), x), y, capacity - x - y], 1))
        times.append(np.ones((len(y), 3), np.int64))
    return np.concatenate(held), np.concatenate(times)


def fit(held: np.ndarray, times: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """How often to use each pattern: non-negative least squares by coordinate steps from zero.

    A round takes the patterns whose own best step lowers the squares most, none with a length in common, so that their
    steps are exact together. Starting from zero keeps the counts few and large, which rounding needs.
    """
    x, left = np.zeros(len(held)), histogram.astype(float)
    curve = (times * times).sum(1).astype(float)
    left[0] = 0
    for _ in range(ROUNDS if len(held) else 0):
        slope = (times * left[held]).sum(1)
        step = np.maximum(slope / curve, -x)
        gain = step * (2 * slope - step * curve)
        top = np.argpartition(-gain, min(LOOKED_AT, len(gain)) - 1)[:LOOKED_AT]
        top = top[np.lexsort((top, -gain[top]))]
        taken, picked = np.zeros(len(left), bool), []
        for k, (a, b, c) in zip(top[gain[top] > 0].tolist(), held[top].tolist()):
            if not (taken[a] or taken[b] or taken[c]):
                taken[[a, b, c]] = True
                taken[0] = False
                picked.append(k)
        if not picked or np.abs(step[picked]).max() < STILL:
            break
        x[picked] += step[picked]
        np.subtract.at(left, held[picked].ravel(), (times[picked] * step[picked, None]).ravel())
        left[0] = 0
    return x


def fitted(histogram: np.ndarray, capacity: int) -> tuple[Plan, np.ndarray]:
    """The rounded patterns with their counts, and the pieces by length that they leave."""
    left = np.array(histogram, np.int64)
    held, times = patterns(left, capacity)
    counts = fit(held, times, left)
    plan: Plan = []
    for k in np.argsort(-counts, kind="stable").tolist():
        if counts[k] < 0.5:
            break
        own, often = held[k][times[k] > 0], times[k][times[k] > 0]
        n = min(int(np.rint(counts[k])), int((left[own] // often).min()))
        if n > 0:
            left[own] -= n * often
            plan.append((tuple(np.repeat(own, often).tolist()), n))
    return plan, left


def make_plan(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Patterns with counts that use up the histogram exactly (index: length)."""
    plan, left = fitted(histogram, capacity)
    return plan + best_fit(left, capacity)


class Places:
    """Where the k-th piece of a length goes."""

    SHIFT = 40

    def __init__(self, plan: Plan):
        used: dict[int, int] = {}
        rows, base = [], 0
        for pattern, n in plan:
            at = 0
            for length in sorted(set(pattern), reverse=True):
                m = pattern.count(length)
                first = used.get(length, 0)
                rows.append(((length << self.SHIFT) + first, first, base, m, at))
                used[length] = first + n * m
                at += m * length
            base += n
        self.n_sequences = base
        rows.sort()
        self.table = np.array(rows, np.int64).reshape(-1, 5)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset."""
        t = self.table[np.searchsorted(self.table[:, 0], (length << self.SHIFT) + rank, side="right") - 1]
        r = rank - t[:, 1]
        return t[:, 2] + r // t[:, 3], t[:, 4] + r % t[:, 3] * length


def _cutter(tokenizer: str, end_id: int, capacity: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer).encode_all, TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u2").tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids")}
            for doc_id, got in zip(batch.column(0).to_pylist(), encode(t.as_py() or "" for t in batch.column(1))):
                ids = np.frombuffer(got + end, "<u2")
                first = (len(ids) - 1) % capacity + 1
                for k, a in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[a : first if k == 0 else a + capacity]
                    cols["doc_id"].append(doc_id)
                    cols["piece"].append(k)
                    cols["start"].append(a)
                    cols["length"].append(len(own))
                    cols["ids_crc32"].append(zlib.crc32(own.astype("<u4").tobytes()))
                    cols["rank"].append(int(seen[len(own)]))
                    if keep_ids:
                        cols["ids"].append(own.tobytes())
                    seen[len(own)] += 1
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "rank": pa.int64()}
            if keep_ids:
                types["ids"] = pa.binary()
            out = {k: pa.array(cols[k], t) for k, t in types.items()}
            yield pa.RecordBatch.from_pydict(out | {"part": pa.array([part] * len(cols["rank"]), pa.int32())})

    return cut


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids].

    A document is its ids and then ``end_id``; only longer ones than ``capacity`` are cut, and then the first piece is the
    one that may be shorter. Null and empty texts are the end id alone; repeated rows are packed each; a null doc_id stays
    null. No documents give no pieces. Offsets in a sequence have no gaps.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long" + ", ids binary" * keep_ids + ", part int"
    pieces = materialise(rows.mapInArrow(_cutter(tokenizer or tokenizer_path(), end_id, capacity, keep_ids), schema), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # capacity rows at most
        histogram[r.length] = r.n
    places = Places(make_plan(histogram, capacity))
    # one row for each task and length: far fewer than there are pieces
    earlier = by_part.select(
        "part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("before")
    )

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in places.of(length.to_numpy(), rank.to_numpy())], ["sequence_id", "offset"])

    placed = pieces.join(earlier, ["part", "length"]).withColumn("at", place("length", F.col("rank") + F.coalesce("before", F.lit(0))))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset")]
    return placed.select(*out, *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack(..., keep_ids=True)``: sequence_id, length, ids (little-endian 16-bit), doc_ids."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"), F.sum("length").alias("length"))
        .select("sequence_id", "length", F.concat(F.array_join(F.transform("p", lambda x: F.hex(x.ids)), "")).alias("h"), F.col("p.doc_id").alias("doc_ids"))
        .select("sequence_id", "length", F.unhex("h").alias("ids"), "doc_ids")
    )
