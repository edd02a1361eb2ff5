import numpy as np

from tidemark.plans import frozen as Z
from tidemark.plans.cluster import distances


def rows(seed=0):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(0, 0.3, (60, 2)), r.normal(6, 0.3, (60, 2))])
    return [("t", int(k), int(k >= 60), float(a), float(b)) for k, (a, b) in enumerate(x)]


SCHEMA = "target string, tx long, cluster int, f double, g double"


def test_columns_give_what_a_plain_walk_gives(spark):
    train = rows()
    verdicts = spark.createDataFrame([("t", 1, "malicious")], "target string, cluster int, verdict string")
    model = Z.fit(spark.createDataFrame(train + [("few", 1, 0, 0.0, 0.0)], SCHEMA), "target", "cluster", ["f", "g"], verdicts, trees=40).cache()
    m = model.collect()
    assert [r.target for r in m] == ["t"]
    m = m[0]
    new = [("t", 1, 0.1, 0.0), ("t", 2, 6.0, 6.1), ("t", 3, 40.0, -40.0), ("t", 4, 3.0, 3.0), ("t", 5, None, 0.0), ("other", 6, 0.0, 0.0)]
    got = {r.tx: r for r in Z.classify(spark.createDataFrame(new, "target string, tx long, f double, g double"), model, "target", "tx", ["f", "g"]).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert (got[1].cluster, got[1].verdict) == (0, "normal") and (got[2].cluster, got[2].verdict) == (1, "malicious")
    assert (got[3].cluster, got[3].votes, got[3].verdict) == (-1, 2, "anomaly") and got[3].consensus == 1.0
    trees = [[(n.feature, n.cut, n.left, n.right, n.path) for n in t] for t in m.forest]
    points = np.array([p.x for p in m.points])
    for t, tx, f, g in new[:5]:
        x = (np.array([f or 0.0, g]) - m.center) / m.scale
        assert abs(got[tx].iso - Z.isolation_scores(x[None], trees, m["size"])[0]) < 1e-9
        d = np.linalg.norm(points - x, axis=1)
        near = np.argsort(d, kind="stable")[: m.k]
        reach = np.maximum(d[near], [m.points[k].far for k in near]).mean() + 1e-10
        assert abs(got[tx].lof - np.mean([m.points[k].density for k in near]) * reach) < 1e-6
    # the thresholds are those that training rows were held against
    x = np.array([[r[3], r[4]] for r in train])
    x = (x - m.center) / m.scale
    assert abs(m.iso.threshold - np.quantile(Z.isolation_scores(x, trees, m["size"]), 0.95)) < 1e-9
    assert abs(m.lof.threshold - np.quantile(Z.neighbours(x, m.k)[2], 0.95)) < 1e-9


def test_equal_rows_and_no_clusters(spark):
    model = Z.fit(spark.createDataFrame([("t", k, -1, 1.0, 1.0) for k in range(5)], SCHEMA), "target", "cluster", ["f", "g"], trees=3)
    got = Z.classify(spark.createDataFrame([("t", 9, 1.0, 1.0)], "target string, tx long, f double, g double"), model, "target", "tx", ["f", "g"]).collect()
    assert [(r.cluster, r.tx) for r in got] == [(-1, 9)]


def test_planted_distances_come_back(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 3))
    at = Z.scaled_positions(distances(x), 3)
    assert np.abs(distances(at) - distances(x)).max() < 1e-6
    assert Z.scaled_positions(np.zeros((0, 0))).shape == (0, 3) and not Z.scaled_positions(np.zeros((2, 2))).any()
    d = spark.createDataFrame([("t", k, *map(float, v)) for k, v in enumerate(x)] + [("u", 1, 1.0, 2.0, 3.0)], "target string, tx long, a double, b double, c double")
    got = {(p.target, p.tx): p.at for p in Z.positions(d, "target", "tx", ["a", "b", "c"]).collect()}
    own = np.array([got["t", k] for k in range(40)])
    assert np.abs(distances(own) - distances(x)).max() < 1e-6 and got["u", 1] == [0.0, 0.0, 0.0]


def test_parts_of_a_target_meet_its_model(spark, monkeypatch):
    monkeypatch.setattr(Z, "PART", 15)
    r = np.random.default_rng(1)
    train = rows() + [("u", *x[1:]) for x in rows(3)[:70]]
    model = Z.fit(spark.createDataFrame(train, SCHEMA), "target", "cluster", ["f", "g"], trees=20).cache()
    new = [(k, n, *map(float, r.normal(3, 4, 2))) for n, k in enumerate(["t"] * 100 + ["u"] * 9 + ["v"] * 40)] + [("t", 500, float("nan"), 0.0), (None, 501, 0.0, 0.0)]
    asked = spark.createDataFrame(new, "target string, tx long, f double, g double")
    plan = Z.classify(asked, model, "target", "tx", ["f", "g"])
    got = {x.tx: x for x in plan.collect()}
    assert set(got) == {*range(109), 500} and got[500].cluster == -1 and np.isnan(got[500].lof)
    monkeypatch.setattr(Z, "PART", 10**6)
    assert {x.tx: x for x in Z.classify(asked, model, "target", "tx", ["f", "g"]).collect() if x.tx != 500} == {k: v for k, v in got.items() if k != 500}
