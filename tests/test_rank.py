import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import stats


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_rank_share_against_counting(spark, keys):
    r = random.Random(1)
    rows = [(i, r.choice("ab"), r.choice([None, *range(0, 600, 3)])) for i in range(900)] + [(900, "c", 5), (901, "d", None), (902, "d", None)]
    got = {x.i: x.r for x in stats.rank_percentile(spark.createDataFrame(rows, "i int, k string, v int"), "v", "r", keys).collect()}
    assert len(got) == len(rows)
    for i, k, v in rows:
        own = [-1 if w is None else w for _, q, w in rows if not keys or q == k]
        want = None if v is None else 0.0 if len(own) < 2 else (sum(w < v for w in own) + (own.count(v) - 1) / 2) / (len(own) - 1)
        assert got[i] == want or abs(got[i] - want) < 1e-12


def test_rank_share_of_nothing(spark):
    assert stats.rank_percentile(spark.createDataFrame([], "v double"), "v", "r").count() == 0


def test_robust_scale_by_interpolated_quartiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 7, 1000):
        v = np.round(rng.normal(size=n), 2)
        rows = [(i, float(x), 5.0, None) for i, x in enumerate(v)] + [(-1, None, 5.0, None)]
        d = spark.createDataFrame(rows, "i int, a double, b double, c double")
        got = {r.i: r for r in stats.robust_scale(d, ["a", "b", "c"]).collect()}
        low, mid, high = np.quantile(v, [0.25, 0.5, 0.75])
        spread = high - low or 1.0
        assert len(got) == n + 1 and got[-1].a is None and all(r.b == 0 and r.c is None for r in got.values())
        assert all(abs(got[i].a - (x - mid) / spread) < 1e-9 for i, x in enumerate(v))
    assert stats.robust_scale(d.limit(0), ["a"]).count() == 0


def test_percentiles_whose_ranges_are_cut_anew_each_time(spark, monkeypatch):
    """Approximate quantiles differ with the order in which executors' parts arrive. Here they differ each time they are worked out."""
    drawn = F.udf(lambda _: sorted(random.random() * 1000 for _ in range(7)), "array<double>").asNondeterministic()
    monkeypatch.setattr(stats.F, "percentile_approx", lambda v, *_: drawn(F.count(v)))
    r = random.Random(2)
    rows = [(k, float(r.randrange(1000))) for k in ("a", "b", None) for _ in range(500)] + [("c", 1.0)]
    d = spark.createDataFrame(rows, "k string, v double")
    for whole in (100, 100_000):
        monkeypatch.setattr(stats, "WHOLE", whole, raising=False)
        got = {x.k: (x.p50, x.p99, x.n) for x in stats.exact_percentiles(d, ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
        assert set(got) == {"a", "b", "c", None}
        for k, found in got.items():
            v = sorted(x for q, x in rows if q == k)
            assert found == (v[math.floor(0.5 * len(v))], v[math.floor(0.99 * len(v))], len(v))
