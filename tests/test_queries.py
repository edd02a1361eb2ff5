import random
from datetime import datetime, timedelta
from itertools import combinations

from tidemark.operators import joins
from tidemark.queries import QUERIES


def tables(spark, path, **rows):
    """A folder of small tables; each is given as (schema, rows)."""
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_jaccard_pairs_of_late_orders(spark, tmp_path):
    items = {1: {1, 2, 3}, 2: {2, 3, 4}, 2999: {1, 2}, 3000: {7, 8, 9}, 4001: {7, 8}, 9_000_000: {1, 2, 3, 7}, 9_000_001: {50}}
    sf = tables(spark, tmp_path, lineitem=("l_orderkey long, l_partkey long", [(k, i) for k, v in items.items() for i in [*v, min(v)]]))
    want = {(a, b): (len(items[a] & items[b]), len(items[a] & items[b]) / len(items[a] | items[b])) for a, b in combinations(sorted(items), 2)}
    got = {(r.a, r.b): (r.common, r.similarity) for r in QUERIES["jaccard_pairs"](spark, sf).collect()}
    assert got == {k: v for k, v in want.items() if v[1] >= 0.2} and (3000, 4001) in got and (1, 9_000_000) in got


def test_jaccard_pairs_are_judged_where_they_meet(spark, monkeypatch):
    r = random.Random(4)
    items = {k: {r.randrange(60) for _ in range(r.choice([1, 2, 4, 6, 30]))} | ({None} if k % 5 == 0 else set()) for k in range(80)}
    d = spark.createDataFrame([(k, i) for k, v in items.items() for i in v] + [(1, min(v for v in items[1] if v is not None))], "k long, i long")
    want = {}
    for a, b in combinations(items, 2):
        n = len((items[a] & items[b]) - {None})
        if n and n / (len(items[a]) + len(items[b]) - n) >= 0.2:
            want[a, b] = (n, n / (len(items[a]) + len(items[b]) - n))
    for small in (64, 8, 0):
        monkeypatch.setattr(joins, "SMALL", small)
        pairs = joins.jaccard_pairs(d, "k", "i", 0.2)
        assert {(x.a, x.b): (x.common, x.similarity) for x in pairs.collect()} == want and pairs.count() == len(want)


def first_returns(edges, hops, reach):
    """origin -> (cycle_length, slot), by a search from each origin alone."""
    found = {}
    for origin in {u for u, v, _ in edges if u != v}:
        own = [(v, s) for u, v, s in edges if u == origin != v]
        first, front = min(s for _, s in own), {}
        for v, s in own:
            front[v] = min(s, front.get(v, s))
        seen = set(front)
        for hop in range(1, hops + 1):
            met = {}
            for u, v, s in edges:
                if u != v and u in front and front[u] <= s <= first + reach:
                    met[v] = min(s, met.get(v, s))
            if origin in met:
                found[origin] = (hop + 1, met[origin])
                break
            front = {v: s for v, s in met.items() if v not in seen}
            seen |= set(front)
    return found


def test_cycle_hops_over_all_edges(spark, tmp_path):
    r = random.Random(5)
    # (supplier's part of the address, customer's, day): a ring of seven, one of eight, one too slow, and some at random
    ring = lambda k, n, day: [(k + i, k + (i + 1) % n, day + i) for i in range(n)]
    edges = ring(0, 7, 1) + ring(10, 8, 1) + ring(20, 4, 1)[:-1] + [(23, 20, 202)] + [(30 + r.randrange(50), 30 + r.randrange(50), r.randrange(400)) for _ in range(150)]
    start = datetime(1995, 1, 1)
    day = (start - datetime(1970, 1, 1)).days
    sf = tables(
        spark, tmp_path,
        lineitem=("l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double", [(i, u, v, 1.0 + i % 50, 0.0) for i, (u, v, _) in enumerate(edges)]),
        orders=("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz", [(i, 1, start + timedelta(s)) for i, (_, _, s) in enumerate(edges)]),
        customer=("c_custkey long, c_nationkey int", [(1, 0)]), supplier=("s_suppkey long, s_nationkey int", [(i, 0) for i in range(90)]),
    )
    got = {x.origin: (x.cycle_length, x.slot) for x in QUERIES["cycle_hops"](spark, sf).collect()}
    assert got == first_returns([(u, v, day + s) for u, v, s in edges], 6, 200)
    assert got[0] == (7, day + 7) and 10 not in got and 20 not in got and len({n for n, _ in got.values()}) > 3


def test_contract_outliers_of_every_customer(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, "A" if k % 400 else "B", r.gauss(0, 100), r.randrange(25)) for k in range(1, 1201)]
    rows[0] = (1, "A", 1e6, 500)  # the oldest one stands out
    got = {x.c_custkey: x for x in QUERIES["contract_outliers"](spark, tables(spark, tmp_path, customer=("c_custkey long, c_mktsegment string, c_acctbal double, c_nationkey int", rows))).collect()}
    assert set(got) == {k for k, *_ in rows}
    assert got[1].score_rank == 1 and got[1].votes == 3 and max(x.score_rank for x in got.values()) == 1197
