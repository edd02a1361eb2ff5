import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing as P
from tidemark.llm import tokens


def used(plan, capacity):
    c = Counter()
    for p, n in plan:
        assert sum(p) <= capacity and n > 0
        for x in p:
            c[x] += n
    return c


def count(plan):
    return sum(n for _, n in plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=300))
def test_plans_use_every_piece_once(lengths):
    h = np.bincount(np.array(lengths, int), minlength=41)
    for plan in (P.make_plan(h, 40), P.best_fit(h, 40)):
        assert used(plan, 40) == Counter(lengths)
        # no two sequences of best fit go into one, and patterns are full
        assert 40 * (count(plan) - 1) <= 2 * sum(lengths)


def least(lengths, capacity):
    """The fewest sequences, by trying all."""
    best = len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[k]}.values():
            put(k + 1, rooms[:j] + [rooms[j] - lengths[k]] + rooms[j + 1 :])
        put(k + 1, rooms + [capacity - lengths[k]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=7))
def test_few_pieces_against_the_optimum(lengths):
    lengths.sort(reverse=True)
    h = np.bincount(np.array(lengths), minlength=25)
    plan, left = P.fitted(h, 24)
    want = least(lengths, 24)
    rest = sorted(np.repeat(np.arange(25), left).tolist(), reverse=True)
    assert want <= count(P.make_plan(h, 24)) <= count(plan) + 11 / 9 * least(rest, 24) + 6 / 9
    assert count(P.best_fit(h, 24)) <= 11 / 9 * want + 6 / 9
    assert all(sum(p) == 24 for p, _ in plan) and (left >= 0).all()


def test_patterns_are_all_that_fill_a_sequence():
    h = np.array([0, 3, 0, 2, 1, 1, 0, 1, 0, 1])
    held, times = P.patterns(h, 9)
    got = {tuple(sorted(Counter({int(a): int(n) for a, n in zip(x, y) if n}).items())) for x, y in zip(held, times)}
    want = set()
    for a in range(4):
        for b in range(3):
            for c in range(2):
                for d in range(2):
                    for e in range(2):
                        for f in range(2):
                            p = {1: a, 3: b, 4: c, 5: d, 7: e, 9: f}
                            p = {k: n for k, n in p.items() if n}
                            if sum(k * n for k, n in p.items()) == 9 and (len(p) < 3 or (len(p) == 3 and max(p.values()) == 1)):
                                want.add(tuple(sorted(p.items())))
    assert got == want


def test_fit_meets_a_histogram_that_patterns_made():
    r = np.random.default_rng(1)
    h = np.zeros(513, np.int64)
    for _ in range(400):
        a, b = sorted(r.integers(1, 512, 2).tolist())
        for x in (a, b - a, 512 - b):
            h[x] += x > 0
    held, times = P.patterns(h, 512)
    x = P.fit(held, times, h)
    made = np.zeros(513)
    np.add.at(made, held.ravel(), (times * x[:, None]).ravel())
    assert (x >= 0).all() and ((made - h)[1:] ** 2).sum() <= 0.01 * (h**2).sum()


def test_patterns_place_most_sequences(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    h = np.bincount([r.length for r in P.pack(texts).select("length").collect()], minlength=2049)
    for histogram in (h, 20 * h):
        plan, left = P.fitted(histogram, 2048)
        rest = P.best_fit(left, 2048)
        assert count(plan) >= 0.85 * (count(plan) + count(rest))
        assert count(plan) + count(rest) <= count(P.best_fit(histogram, 2048)) + 1


def test_near_the_bound_for_many_pieces():
    r = random.Random(3)
    lengths = [min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(30000)]
    plan = P.make_plan(np.bincount(lengths, minlength=2049))
    assert sum(n for _, n in plan) <= 1.003 * -(-sum(lengths) // 2048) + 1


def check(spark, rows, capacity):
    d = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    got = P.pack(d, capacity=capacity).collect()
    e = tokens.Encoder(tokens.tokenizer_path()).tokenizer
    want = Counter()
    for i, t, _ in rows:
        ids = e.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
            own = ids[a : first if k == 0 else a + capacity]
            want[i, k, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_pieces_and_places(spark):
    rows = [(k, "some words here " * (k * 7 % 50), 1) for k in range(150)] + [(None, None, 2), (4, "again", 3), (4, "again", 3), (9, "", 1), (10, "long " * 5000, 1)]
    check(spark, rows, 64)
    check(spark, rows, 2048)
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sequences_hold_the_ids(spark):
    d = spark.createDataFrame([(k, "alpha beta " * k) for k in range(20)], "doc_id long, text string")
    p = P.pack(d, capacity=50, keep_ids=True)
    for r in P.sequences(p).collect():
        assert len(r.ids) == 2 * r.length <= 100


def test_texts_of_a_batch_are_encoded_together(monkeypatch):
    import pyarrow as pa
    import pyspark

    class Some:
        def encode_all(self, texts):
            held = list(texts)
            return (np.array([len(held), *map(ord, t)], "<u2").tobytes() for t in held)

    monkeypatch.setattr(P, "encoder", lambda path: Some())
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([7, None, 9]), "text": ["ab", None, "x"]})
    (got,) = P._cutter("", 0, 4, True)(iter([batch]))
    assert got.column("doc_id").to_pylist() == [7, None, 9]
    assert [np.frombuffer(x, "<u2").tolist() for x in got.column("ids").to_pylist()] == [[3, 97, 98, 0], [3, 0], [3, 120, 0]]
