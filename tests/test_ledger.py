import json
import math
import time

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import joins, stats, versions
from tidemark.plans import cluster
from tidemark.sources import files
from tidemark.streaming import ledger


def test_newest_rows_and_rollbacks(spark):
    d = spark.createDataFrame([("n", "t", 1, 5, "a"), ("n", "t", 2, 5, "b"), ("n", "u", 1, 9, "c"), ("m", "u", 1, 9, "d")], "network string, tx string, v int, slot long, x string")
    assert {(r.network, r.tx, r.x) for r in versions.latest_by_key(d, ["network", "tx"], "v").collect()} == {("n", "t", "b"), ("n", "u", "c"), ("m", "u", "d")}
    back = spark.createDataFrame([("n", 6, 2)], "network string, slot long, at int")
    left = versions.without_rolled_back(d, back, "slot", "v")
    assert sorted(r.x for r in left.collect()) == ["a", "b", "d"]
    assert versions.without_rolled_back(d.withColumn("v", F.lit(3)), back, "slot", "v").count() == 4
    assert versions.new_rows(d, d.filter("tx = 't'"), ["tx"]).count() == 1


def test_exact_percentiles_of_hot_and_small_keys(spark):
    r = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in r.integers(0, 3000, 9000)] + [("one", 4.0), ("tie", 1.0)] + [("tie", 2.0)] * 50 + [("none", None)]
    got = {x.k: (x.p50, x.p99, x.n) for x in stats.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    for k in ("hot", "one", "tie"):
        v = sorted(x for a, x in rows if a == k)
        assert got[k] == (v[math.floor(0.5 * len(v))], v[math.floor(0.99 * len(v))], len(v))
    assert "none" not in got


def test_cycles_stop_at_the_first_return(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("x", "y", 1), ("y", "x", 2), ("y", "z", 2), ("z", "x", 3), ("p", "q", 9), ("q", "p", 1)], "src string, dst string, slot long")
    got = {r.origin: (r.cycle_length, r.slot) for r in joins.cycles(e, reach=100).collect()}
    assert got["a"] == (3, 3) and got["x"] == (2, 2) and "p" not in got


def test_range_neighbours_at_bucket_edges(spark):
    a = spark.createDataFrame([("k", i) for i in range(0, 60, 7)], "k string, x long")
    b = spark.createDataFrame([("k", i) for i in range(0, 60, 3)], "k string, y long")
    got = {(r.x, r.y) for r in joins.range_neighbours(a, b, ["k"], "x", "y", 5).collect()}
    assert got == {(x, y) for x in range(0, 60, 7) for y in range(0, 60, 3) if abs(x - y) <= 5}


def test_clusters_and_planted_outliers(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 0.3, (80, 2)), r.normal(6, 0.3, (80, 2)), [[30.0, -30.0]]])
    rows = [("t", k, float(a), float(b)) for k, (a, b) in enumerate(x)] + [("few", 1, 0.0, 0.0)]
    got = cluster.outliers(spark.createDataFrame(rows, "target string, tx long, f double, g double"), "target", "tx", ["f", "g"]).toPandas().set_index("tx")
    assert len(got) == 161 and got.loc[160].score_rank == 1 and got.loc[160].votes == 3 and got.cluster.max() >= 1
    assert len({got.cluster[k] for k in range(80) if got.cluster[k] >= 0} & {got.cluster[k] for k in range(80, 160) if got.cluster[k] >= 0}) == 0
    assert cluster.silhouette(cluster.distances(x), np.repeat([0, 1, -1], [80, 80, 1])) > 0.8
    assert cluster.rank_share(np.array([1, 1, 3])).tolist() == [0.25, 0.25, 1.0]


def test_frozen_model_places_new_rows(spark):
    old = spark.createDataFrame([("t", c, float(10 * c + k % 3)) for c in (0, 1) for k in range(30)] + [("t", -1, 99.0)], "target string, cluster int, f double")
    new = spark.createDataFrame([("t", 1, 0.9), ("t", 2, 11.2), ("t", 3, 500.0)], "target string, tx long, f double")
    got = {r.tx: r.cluster for r in cluster.classify(new, cluster.fit_model(old, "target", "cluster", ["f"]), "target", "tx", "cluster", ["f"]).collect()}
    assert got == {1: 0, 2: 1, 3: -1}


def block(spark, tmp_path, name, events):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, events)))


def test_block_stream_is_idempotent_and_rolls_back(spark, tmp_path):
    tx = lambda i: json.dumps({"id": i, "inputs": [{"transaction": "p", "index": 0}], "outputs": [{"address": "addr1qx", "value": {"lovelace": 3}}], "fee": 1})
    forward = lambda slot, *ids: {"direction": "forward", "network": "n", "slot": slot, "block_hash": f"h{slot}", "height": slot, "ts": "2024-01-01T00:00:00Z", "txs": [tx(i) for i in ids]}
    block(spark, tmp_path, "a.json", [forward(1, "t1", "t2"), forward(2, "t3") | {"txs": [tx("t3"), "{broken"]}])
    root = str(tmp_path / "out")

    def run():
        src = spark.readStream.schema(ledger.EVENT).json(str(tmp_path / "in"))
        src.writeStream.foreachBatch(ledger.ingest(spark, src, root)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    def now():
        rows = versions.latest_by_key(spark.read.parquet(f"{root}/transactions"), ["network", "tx_hash"], "ingestion_timestamp", ["slot", "batch_id"])
        return sorted(r.tx_hash for r in versions.without_rolled_back(rows, spark.read.parquet(f"{root}/rollbacks")).collect())

    run()
    assert now() == ["t1", "t2", "t3"] and spark.read.parquet(f"{root}/failed").count() == 1
    ledger.ingest(spark, None, root)(spark.read.schema(ledger.EVENT).json(str(tmp_path / "in")), 0)  # replayed
    assert now() == ["t1", "t2", "t3"]
    block(spark, tmp_path, "b.json", [{"direction": "backward", "network": "n", "slot": 1, "txs": []}])
    run()
    assert now() == ["t1", "t2"]


def test_a_poisoned_payload_is_kept_and_the_others_are_written(spark, tmp_path):
    tx = lambda i: json.dumps({"id": i, "inputs": [], "outputs": [{"address": "addr1qx", "value": {"lovelace": 3}}], "fee": 1})
    events = [{"direction": "forward", "network": "n", "slot": k, "block_hash": f"h{k}", "height": k, "ts": "2024-01-01T00:00:00Z", "txs": [tx(f"t{k}-{j}") for j in range(5)]} for k in range(6)]
    events[2]["txs"][3], events[4]["txs"][0] = tx("poison1"), tx("poison2")
    events[5]["txs"].append("{broken")
    block(spark, tmp_path, "a.json", events)
    root = str(tmp_path / "out")

    def features(txs, *more):
        wrong = F.when(F.col("tx_hash").startswith("poison"), F.raise_error(F.concat(F.lit("bad "), "tx_hash")))
        return ledger.features_of(txs, *more).withColumn("ada", F.coalesce(wrong.cast("double"), F.col("ada")))

    rows = spark.read.schema(ledger.EVENT).json(str(tmp_path / "in"))
    for _ in range(2):
        ledger.ingest(spark, None, root, features=features)(rows, 0)
        assert spark.read.parquet(f"{root}/transactions").count() == 30
        found = {r.tx_hash for r in spark.read.parquet(f"{root}/utxo_features").collect()}
        assert len(found) == 28 and not any(x.startswith("poison") for x in found)
        failed = sorted((json.loads(r.raw_data)["id"] if r.raw_data != "{broken" else "", r.reason) for r in spark.read.parquet(f"{root}/failed").collect())
        assert [x for x, _ in failed] == ["", "poison1", "poison2"] and "bad poison1" in failed[1][1]


def test_the_middle_of_unequal_keys_always_parts_them(spark):
    d = spark.createDataFrame([(-5,), (7,), (8,)], "k long")
    bad = ledger.poisoned(d, lambda rows: rows.withColumn("x", F.when(F.col("k") != 7, F.raise_error(F.lit("no")))), "k")
    assert sorted(r.k for r in bad.collect()) == [-5, 8] and ledger.poisoned(d, lambda rows: rows, "k") is None


def collect_stream(df, name, n):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    until = time.time() + 120
    while time.time() < until and df.sparkSession.table(name).count() < n:
        time.sleep(0.5)
    q.stop()
    return df.sparkSession.table(name).collect()


def test_pending_collisions_and_lifecycle_streams(spark, tmp_path):
    (tmp_path / "p").mkdir()
    rows = [{"tx": "a", "at": 1.0, "refs": ["r", "s"]}, {"tx": "b", "at": 5.0, "refs": ["r"]}, {"tx": "c", "at": 9000.0, "refs": ["r"]}, {"tx": "b", "at": 6.0, "refs": ["r"]}]
    (tmp_path / "p" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    got = collect_stream(ledger.pending_collisions(spark.readStream.schema("tx string, at double, refs array<string>").json(str(tmp_path / "p"))), "pc", 1)
    assert [(r.tx_a, r.tx_b, r.delta) for r in got] == [("a", "b", 4.0)]
    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "tx_a string, tx_b string")
    assert {r.tx_a: r.outcome for r in ledger.outcome(pairs, spark.createDataFrame([("b",)], "tx_id string")).collect()} == {"a": "TX_B_CONFIRMED", "c": "BOTH_PENDING"}
    (tmp_path / "l").mkdir()
    ev = [("t", "seen", 0), ("t", "confirmed", 2), ("u", "seen", 1), ("v", "confirmed", 3), ("v", "rolled_back", 4)]
    (tmp_path / "l" / "x.json").write_text("\n".join(json.dumps({"tx_id": t, "event": e, "at": f"2024-01-01T00:00:0{s}Z"}) for t, e, s in ev))
    schema = "tx_id string, event string, at timestamp"
    want = {(r.tx_id, r.status, r.latency_ms) for r in ledger.lifecycle(spark.read.schema(schema).json(str(tmp_path / "l"))).collect()}
    assert want == {("t", "CONFIRMED", 2000), ("u", "PENDING", None), ("v", "ROLLED_BACK", None)}
    q = ledger.lifecycle_stream(spark.readStream.schema(schema).json(str(tmp_path / "l")))
    assert {(r.tx_id, r.status, r.latency_ms) for r in collect_stream(q, "lc", 3)} == want


def test_raw_store_and_csv(spark, tmp_path):
    d = spark.createDataFrame([("n", "aa1", "20240101", "{}"), ("m", "ab2", "20240101", "{}")], "network string, tx_hash string, day string, raw_data string")
    for _ in range(2):
        files.write_raw(d, str(tmp_path / "raw"))
    assert [r.tx_hash for r in files.read_raw(spark, str(tmp_path / "raw"), "n").collect()] == ["aa1"]
    files.export_csv(spark.createDataFrame([("a", "=1+1"), ("b", "plain"), ("b", "twice")], "k string, note string"), str(tmp_path / "csv"))
    rows, counts = files.import_csv(spark, str(tmp_path / "csv"), "k string, note string", spark.createDataFrame([("a",)], "k string"), ["k"])
    assert [r.k for r in rows.collect()] == ["b"] and tuple(counts.first()) == (1, 2)
    assert "'=1+1" in {r.note for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}


def test_paged_source(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"h": f"{k}-{j}"} for j in range(2)]))
    spark.dataSource.register(files.PagedSource)
    got = spark.read.format("json_pages").option("url", f"file://{tmp_path}/{{page}}.json").option("pages", 2).load()
    assert sorted(json.loads(r.item)["h"] for r in got.collect()) == ["1-0", "1-1", "2-0", "2-1"]
