import math
import random

import numpy as np

from tidemark.llm import hard_negatives as H


def brute(rows):
    kept = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]))
    out = []
    for k, (i, y, v) in enumerate(kept):
        if i % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, z) for m, (j, z, w) in enumerate(kept) if m != k)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            within = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(within[:3], 1)]
    return sorted(out)


def vectors(seed=5, n=900, wide=8):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(wide)] for _ in range(6)]
    rows = []
    for k in range(n):
        c = centers[k % 6]
        rows.append((k, [float(np.float32(x + r.gauss(0, 0.7))) for x in c], r.randrange(10)))
    same = rows[3][1]
    rows += [(1000 + k, same, k % 3) for k in range(300)]  # ties
    odd = [(None, same, 1), (2000, None, 1), (2001, same, None), (2050, [1.0, None] * 4, 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 2), (2200, [], 3), (2250, same[:3], 1), (2300, same + [2.0], 1)]
    return rows + odd + [rows[50], rows[50], rows[57], (50, same, 4), (-50, same, 5), (-7, same, 9)]


def test_matches_brute_force(spark, monkeypatch):
    rows = vectors()
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame([(*x, "k", 1) for x in rows], "vec_id long, embedding array<float>, label int, anchor string, score int")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 150
    assert sorted(map(tuple, H.report(d).select(*columns).collect())) == want
    monkeypatch.setattr(H, "BUNCH_BYTES", 600)
    monkeypatch.setattr(H, "ROWS", 50)
    assert sorted(map(tuple, H.report(d.repartition(5)).select(*columns).collect())) == want


def test_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert H.report(empty).count() == 0
    alone = spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert H.report(alone).count() == 0
    zero = spark.createDataFrame([(50, [0.0], 1), (51, [0.0], 1), (52, [0.0], 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in H.report(zero).collect()] == [(50, 51, 1, 52, 0, 0)]


def test_large_components_stay_exact():
    a = np.array([[2**40, 3], [2**62, 1]], np.int64)
    assert H.products(a, a).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 2**63 - 1]]
    b = np.array([[2**31, -5]], np.int64)
    assert H.products(b, b).tolist() == [[2**62 + 25]]
