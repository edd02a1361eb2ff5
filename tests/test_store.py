import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.plans import baselines
from tidemark.sources.store import Store, Stored, put_scores
from tidemark.streaming.poll import Poll, drain_stream

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def scores(spark, *rows):
    """(tx_hash, day, large_value) as rows of scores."""
    d = spark.createDataFrame([("n", h, d, v, v) for h, d, v in rows], "network string, tx_hash string, of string, large_value double, max_score double")
    return d.withColumn("of", F.to_date("of"))


def put(store, batch, *rows):
    put_scores(store, scores(store.spark, *rows), batch, F.lit(T0 + timedelta(hours=batch)), F.col("of"))


def read(store, **days):
    return sorted((r.tx_hash, r.large_value, r.phishing) for r in store.read("tx_class_scores", **days).collect())


def files(store, day):
    top = f"{store.root}/tx_class_scores/day={day}"
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(top) for f in fs}


def test_replayed_batches_change_no_row_and_days_prune_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert read(store) == [] and store.days("tx_class_scores") == {}
    put(store, 0, ("a", "2024-01-01", 5.0), ("b", "2024-01-02", 6.0))
    put(store, 1, ("a", "2024-01-01", 7.0), ("c", "2024-01-03", None))
    want = [("a", 7.0, -1.0), ("b", 6.0, -1.0), ("c", -1.0, -1.0)]
    assert read(store) == want
    put(store, 1, ("a", "2024-01-01", 7.0), ("c", "2024-01-03", None))
    assert read(store) == want and store.rows("tx_class_scores").count() == 4
    assert store.days("tx_class_scores") == {"2024-01-01": [0, 1], "2024-01-02": [0], "2024-01-03": [1]}
    some = store.read("tx_class_scores", "2024-01-02", "2024-01-02")
    assert read(store, since="2024-01-02", until="2024-01-02") == [want[1]]
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().toString()


def test_prune_and_compaction_touch_their_days_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for k in range(4):
        put(store, k, ("a", "2024-01-01", float(k)), (f"x{k}", "2024-01-02", 1.0), ("z", "2024-01-04", 2.0))
    put(store, 4, ("only", "2024-01-03", 1.0))
    before = {d: files(store, d) for d in ("2024-01-01", "2024-01-03", "2024-01-04")}
    gone = spark.createDataFrame([("n", "x1"), ("n", "only"), ("n", "nowhere")], "network string, tx_hash string")
    assert store.compact("tx_class_scores", gone) == ["2024-01-02", "2024-01-03"]
    assert store.days("tx_class_scores") == {"2024-01-01": [0, 1, 2, 3], "2024-01-02": [3], "2024-01-04": [0, 1, 2, 3]}
    assert files(store, "2024-01-01") == before["2024-01-01"] and files(store, "2024-01-04") == before["2024-01-04"]
    want = [("a", 3.0, -1.0), ("x0", 1.0, -1.0), ("x2", 1.0, -1.0), ("x3", 1.0, -1.0), ("z", 2.0, -1.0)]
    assert read(store) == want
    assert store.compact("tx_class_scores", batches=3) == ["2024-01-01", "2024-01-04"] and read(store) == want
    assert store.rows("tx_class_scores").count() == 5
    with pytest.raises(ValueError):
        store.prune("tx_class_scores", "2024-01-03", capped=True)
    left = files(store, "2024-01-04")
    assert store.prune("tx_class_scores", "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert files(store, "2024-01-04") == left and read(store) == [want[-1]]


def test_own_tables_and_missing_columns(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"own": Stored(None, ("k",), None)})
    store.put("own", spark.createDataFrame([(1, "a")], "k long, v string"), 0)
    assert [tuple(r) for r in store.read("own").collect()] == [(1, "a")]
    store.put("baselines", spark.createDataFrame([("f", 1, "extra")], "feature string, p50 int, more string"), 0)
    row = store.read("baselines").first()
    assert (row.feature, row.p50, row.scope_id) == ("f", 1.0, None) and "more" not in row


# --- baselines --------------------------------------------------------------------------------------------------------


def fresh(spark, now, *rows):
    d = spark.createDataFrame(rows, "scope_id string, feature string, p50 double, p99 double")
    return d.select(F.lit("n").alias("network"), F.lit("script").alias("scope_type"), "scope_id", "feature", "p50", "p99", F.lit(9).alias("sample_count"), F.lit(now).alias("computed_at"))


def test_drifting_baselines_are_held_one_way_or_both_and_logged(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = [("s", f, 10.0, 100.0) for f in ("same", "wider", "narrower", "two_way", "median")] + [("s", "zero", 0.0, 0.0)]
    baselines.recompute(store, fresh(spark, T0, *first), 0)
    second = [("s", "same", 11.0, 110.0), ("s", "wider", 10.0, 200.0), ("s", "narrower", 4.0, 40.0), ("s", "two_way", 10.0, 40.0), ("s", "median", 20.0, 100.0), ("s", "zero", 0.0, 5.0), ("s", "new", 1.0, 9.0)]
    later = T0 + timedelta(days=1)
    for _ in range(2):  # written again, nothing changes
        baselines.recompute(store, fresh(spark, later, *second), 1, two_way=["two_way"])
        got = {r.feature: (r.p50, r.p99) for r in store.read("baselines").collect()}
        assert got == {"same": (11.0, 110.0), "wider": (10.0, 100.0), "narrower": (4.0, 40.0), "two_way": (10.0, 100.0), "median": (10.0, 100.0), "zero": (0.0, 5.0), "new": (1.0, 9.0)}
        log = {(r.feature, r.axis): (r.old_value, r.new_value, r.applied) for r in store.read("baseline_drift_events").collect()}
        assert log == {
            ("wider", "p99"): (100.0, 200.0, False), ("narrower", "p50"): (10.0, 4.0, True), ("narrower", "p99"): (100.0, 40.0, True), ("two_way", "p99"): (100.0, 40.0, False),
            ("median", "p50"): (10.0, 20.0, False), ("zero", "p99"): (0.0, 5.0, True),
        }


def test_measured_features_in_one_pass(spark):
    rows = spark.createDataFrame([("s", float(k), None if k % 2 else 2.0 * k) for k in range(100)] + [("t", 1.0, None), (None, 5.0, 5.0)], "who string, a double, b double")
    got = {(r.scope_id, r.feature): (r.p50, r.p99, r.sample_count) for r in baselines.measured(rows, "n", "script", ["a", "b"], F.lit(T0), "who").collect()}
    assert got == {("s", "a"): (50.0, 99.0, 100), ("s", "b"): (100.0, 196.0, 50), ("t", "a"): (1.0, 1.0, 1)}
    every = baselines.measured(rows, "n", "global", ["a"], F.lit(T0), least=102).collect()
    assert [(r.scope_id, r.sample_count) for r in every] == [("global", 102)] and baselines.measured(rows, "n", "global", ["a"], F.lit(T0), least=103).count() == 0


# --- polls ------------------------------------------------------------------------------------------------------------

TX = "network string, tx_hash string, ingestion_timestamp timestamp, timestamp timestamp, value double"


def txs(spark, *rows):
    at = lambda s: T0 + timedelta(seconds=s)
    return spark.createDataFrame([("n", h, at(s), at(86400 * (s // 1000)), float(s)) for h, s in rows], TX)


def analyse(rows):
    return rows.select("network", "tx_hash", F.col("value").alias("large_value"), F.col("value").alias("max_score"))


def test_a_failing_sink_loses_and_doubles_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    there = [(f"t{k}", 100 * k) for k in range(7)]
    time = [T0]
    poll = Poll(store, "n", lambda: txs(spark, *there), analyse, batch=3, clock=lambda: time[0])
    assert poll.step() == 3
    put_ = store.put

    def broken(table, *a, **k):
        put_(table, *a, **k)
        if table == "tx_class_scores":
            raise OSError("sink")

    store.put = broken
    with pytest.raises(OSError):
        poll.step()
    store.put = put_
    assert poll.cursor()[2] == 0, "the cursor stays where it was"
    assert poll.drain() == 4, "the rows of the batch that failed, and the last one"
    rows = store.rows("tx_class_scores").collect()
    assert sorted(r.tx_hash for r in rows) == [f"t{k}" for k in range(7)]


def test_overlap_rescan_and_deferred_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    there, time, hold = [("a", 1000), ("b", 2000)], [T0], {"b"}
    poll = Poll(store, "n", lambda: txs(spark, *there), lambda rows: analyse(rows.filter(~F.col("tx_hash").isin(*hold) if hold else F.lit(True))), batch=10, clock=lambda: time[0])
    assert poll.drain() == 2 and [r.tx_hash for r in store.rows("tx_class_scores").collect()] == ["a"]
    mark, rescanned, _ = poll.cursor()
    assert mark.astimezone(timezone.utc) == T0 + timedelta(seconds=1880) and rescanned.astimezone(timezone.utc) == T0
    there += [("late", 1900), ("later", 500)]  # one within the overlap, one before it
    assert poll.drain() == 2, "b again, and the late one"
    hold.clear()
    time[0] = T0 + timedelta(seconds=599)
    assert poll.drain() == 1
    assert sorted(r.tx_hash for r in store.rows("tx_class_scores").collect()) == ["a", "b", "late"]
    time[0] = T0 + timedelta(seconds=600)
    assert poll.drain() == 1, "a look at all rows finds what was written before the cursor"
    assert sorted(r.tx_hash for r in store.rows("tx_class_scores").collect()) == ["a", "b", "late", "later"]
    assert poll.drain() == 0


def test_a_stream_is_drained_and_a_failed_batch_comes_again(spark, tmp_path):
    store, source = Store(spark, str(tmp_path / "store")), str(tmp_path / "txs")
    txs(spark, ("a", 1), ("b", 2)).write.parquet(source)
    stream = lambda: spark.readStream.schema(TX).parquet(source)
    drain_stream(spark, stream(), store, analyse, str(tmp_path / "checkpoint"))
    txs(spark, ("c", 3)).write.mode("append").parquet(source)
    put_ = store.put

    def broken(*a, **k):
        put_(*a, **k)
        raise OSError("sink")

    store.put = broken
    with pytest.raises(Exception, match="sink"):
        drain_stream(spark, stream(), store, analyse, str(tmp_path / "checkpoint"))
    store.put = put_
    for _ in range(2):
        drain_stream(spark, stream(), store, analyse, str(tmp_path / "checkpoint"))
    assert sorted(r.tx_hash for r in store.rows("tx_class_scores").collect()) == ["a", "b", "c"]
