import pytest

from tidemark.operators import joins, reads


def test_filter_of_scores(spark):
    rows = [(1, "High", "a", 70.0, 2), (2, "high", "b", 90.0, 1), (3, None, "a", 10.0, 3), (4, "Critical", None, None, 2)]
    d = spark.createDataFrame(rows, "id int, risk_band string, max_class string, max_score double, corroboration_count int")
    got = lambda **k: [r.id for r in d.filter(reads.score_filter(["a", "b"], **k)).collect()]
    assert got() == [1, 2, 3, 4] and got(bands=["HIGH"]) == [1, 2] and got(cls="a") == [1, 3]
    assert got(min_score=70, corroboration=2) == [1]
    with pytest.raises(ValueError):
        reads.score_filter(["a"], cls="c")


def test_sources_watermark_and_labels(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (3, "z")], "k int, v string")
    assert sorted((r.k, r.v) for r in reads.by_priority([a, b], ["k"]).collect()) == [(1, None), (2, "x"), (3, "z")]
    none = spark.createDataFrame([], "k int, at timestamp")
    rows = spark.createDataFrame([(1,), (2,)], "k int").selectExpr("k", "timestamp_seconds(k * 100) AS at")
    assert reads.since_watermark(rows, "at", none, "at", "120 seconds").count() == 2
    assert [r.k for r in reads.since_watermark(rows, "at", rows.filter("k = 2"), "at", "50 seconds").collect()] == [2]
    e = spark.createDataFrame([(1, 1, "p"), (1, 2, None), (2, 1, "q")], "k int, at int, label string")
    assert sorted(r.k for r in reads.labels(e.selectExpr("k", "at", "label"), ["k"], "at", "label").collect()) == [2]


def test_earlier_rows_of_an_actor(spark):
    rows = [(k, k % 3, k * 7 % 11, k % 2 == 0) for k in range(40)] + [(40, None, 1, True)]
    d = spark.createDataFrame(rows, "id int, actor int, at long, hit boolean")
    for r in joins.seen_before(d, "actor", "at", d.hit, "n").collect():
        assert r.n == sum(h for _, a, t, h in rows if a == r.actor and t < r["at"])
    for r in joins.earlier_in_range(d, "actor", "at", 3).collect():
        assert r.earlier == sum(a == r.actor and r["at"] - 3 <= t <= r["at"] for _, a, t, _ in rows)


def test_earlier_rows_of_a_busy_actor(spark):
    """Nearly all rows are of one actor, over a time that takes many stretches."""
    rows = [(k, 0 if k % 10 else 1, (k * k) % 50_021, k % 3 == 0) for k in range(3_000)] + [(-1, 0, None, True)]
    d = spark.createDataFrame(rows, "id int, actor int, at long, hit boolean")
    times = {a: sorted((t, h) for _, b, t, h in rows if b == a and t is not None) for a in (0, 1)}
    seen = joins.seen_before(d, "actor", "at", d.hit, "n").collect()
    assert len(seen) == 3_000
    for r in seen[::37]:
        assert r.n == sum(h for t, h in times[r.actor] if t < r["at"])
    near = joins.earlier_in_range(d, "actor", "at", 400).collect()
    assert len(near) == 3_000
    for r in near[::37]:
        assert r.earlier == sum(r["at"] - 400 <= t <= r["at"] for t, _ in times[r.actor])
