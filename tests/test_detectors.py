import math
import random
import statistics
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.plans import detectors as D

EDGE = "src string, dst string, slot long, amount long"


def plain_cycles(edges, hops, reach):
    """Breadth first for one origin after the other."""
    out = {}
    edges = [e for e in edges if e[0] != e[1]]
    for origin in {u for u, *_ in edges}:
        first = min(s for u, _, s, _ in edges if u == origin)
        front, seen = {}, set()
        for u, v, s, a in edges:
            if u == origin:
                front[v] = min(front.get(v, (math.inf,)), (s, ((v, a, s),)))
        seen |= set(front)
        for hop in range(1, hops + 1):
            met = {}
            for at, (slot, path) in front.items():
                for u, v, s, a in edges:
                    if u == at and slot <= s <= first + reach and slot <= first + reach:
                        met[v] = min(met.get(v, (math.inf,)), (s, path + ((v, a, s),)))
            if origin in met:
                out[origin] = (hop + 1, met[origin][1])
                break
            front = {v: m for v, m in met.items() if v not in seen}
            seen |= set(front)
    return out


def test_paths_equal_a_plain_search(spark):
    r = random.Random(6)
    edges = [(f"a{r.randrange(12)}", f"a{r.randrange(12)}", r.randrange(60), r.randrange(1, 9) * 1000) for _ in range(70)]
    got = {x.origin: (x.cycle_length, tuple(map(tuple, x.path))) for x in D.cycle_paths(spark.createDataFrame(edges, EDGE), hops=5, reach=30).collect()}
    want = plain_cycles(edges, 5, 30)
    assert got == want and len({k for k, _ in want.values()}) >= 2


def test_a_planted_circle_scores_and_its_features_are_right(spark):
    edges = [("o", "p", 10, 50_000_000), ("p", "q", 12, 49_900_000), ("q", "r", 13, 49_800_000), ("r", "o", 14, 49_700_000), ("x", "y", 1, 7), ("y", "x", 900, 3)]
    history = spark.createDataFrame([("o", 6)], "origin string, recurrence int")
    got = {x.origin: x for x in D.circular_scores(spark.createDataFrame(edges, EDGE), history, reach=1000).collect()}
    o, amounts = got["o"], [50e6, 49.9e6, 49.8e6, 49.7e6]
    assert (o.length, o.recurrence, o.round_amount, o.temporal, o.hop_slots) == (4, 6, True, 1.0, 1.33)
    assert o.similarity == round(1 - statistics.stdev(amounts) / statistics.mean(amounts), 4) and o.net_loss == 0.006
    shares = [c / 5 for c in Counter("opqro").values()]
    assert o.entropy == round(-sum(c * math.log2(c) for c in shares) / math.log2(4), 4)
    assert o.circular.score >= 60 and got["x"].circular.score == -1


def test_a_planted_sandwich_is_the_most_profitable_bracket(spark):
    rows = [("t0", "pool", "w", 1, 0, 1.0, False), ("t1", "pool", "w", 40, 0, 1.0, False)]
    rows += [("a", "pool", "bad", 100, -5_000_000, 1.2, False), ("v", "pool", "victim", 101, 0, 1.5, False), ("b", "pool", "bad", 102, 9_000_000, 1.4, False)]
    rows += [("c", "pool", "mild", 100, 0, 1.2, False), ("d", "pool", "mild", 103, 1, 1.4, False), ("e", "pool", "batcher", 100, 0, 1.0, True), ("f", "pool", "batcher", 103, 10**9, 1.0, True)]
    legs = spark.createDataFrame(rows, "tx string, pool string, actor string, at long, net long, rate double, is_script boolean")
    got = {x.victim: x for x in D.sandwich_scores(legs, 5, 100).collect()}
    v = got["v"]
    assert (v.actor, v.before, v.after, v.span, v.profit, v["count"]) == ("bad", "a", "b", 2, 4_000_000, 1)
    earlier = (1.0 + 1.0 + 1.2 + 1.2 + 1.0) / 5
    assert abs(v.rate_delta - (1.5 - earlier) / earlier) < 1e-6 and abs(v.price_impact - 0.2) < 1e-6
    assert v.sandwich.score >= 60


def test_means_as_of_equal_a_plain_loop(spark):
    r = random.Random(2)
    rows = [(r.choice("xyz"), r.randrange(400), float(r.randrange(100))) for _ in range(300)]
    got = D.as_of_mean(spark.createDataFrame(rows, "pool string, at long, rate double"), "pool", "at", "rate", 25, "m").select("pool", "at", F.round("m", 6).alias("m")).collect()
    for x in got:
        own = [v for p, t, v in rows if p == x.pool and x.at - 25 <= t < x.at]
        assert x.m == (round(sum(own) / len(own), 6) if own else None)


def test_origins_that_were_returned_to_go_no_further(spark, monkeypatch):
    """All know all: what is written of a hop is no more than the pairs of addresses, however many ways there are."""
    edges = [(str(i), str(j), s, 5) for i in range(12) for j in range(12) if i != j for s in range(6)]
    for module, ways in ((joins, joins.cycles), (D, D.cycle_paths)):
        written, real = [], module.cut
        monkeypatch.setattr(module, "cut", lambda df, real=real, written=written: (d := real(df), written.append(d.count()))[0])
        got = ways(spark.createDataFrame(edges, EDGE), hops=3, reach=100).collect()
        assert sorted((x.origin, x.cycle_length) for x in got) == sorted((str(i), 2) for i in range(12))
        assert written[0] == len(edges) and max(written[1:]) <= 12 * 11


def test_best_brackets_are_those_of_all_brackets(spark, monkeypatch):
    r = random.Random(7)
    legs = [(k, r.choice("pq"), r.randrange(6), r.randrange(300), r.choice([-1, 0, 1, 1, 5]) * 10**15 + r.randrange(2), 1.0 + r.random(), False) for k in range(400)]
    legs = spark.createDataFrame(legs, "tx long, pool string, actor long, at long, net long, rate double, is_script boolean")
    net = {x.tx: x.net for x in legs.collect()}
    want = {}
    for b in joins.brackets(legs, "pool", "actor", "at", "tx", 20).collect():
        best = (-(net[b.before] + net[b.after]), b.actor, b.before, b.after, b.span)
        want[b.victim] = min(best, want.get(b.victim, best))
    monkeypatch.setattr(D, "brackets", None, raising=False)  # all brackets are never made
    got = {x.victim: (-x.profit, x.actor, x.before, x.after, x.span) for x in D.sandwich_scores(legs, 20, 50).collect()}
    assert len(want) > 100 and got == want
