"""Detectors over many transactions: how money went in a circle, and what a bracket around a victim earned."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.joins import victims_and_gaps
from tidemark.operators.lineage import cut
from tidemark.plans import scorers

ADA = 1_000_000
#: Slots between hops where a path tells none.
HOP_SLOTS = 100
#: Largest share of an amount that fees take.
FEE_RATIO = 0.02
HIGH = 60.0


def cycle_paths(edges: DataFrame, hops: int = 6, reach: int = 86_400) -> DataFrame:
    """origin, cycle_length, path: the shortest way on which money of each origin returns to it, along edges (src, dst, slot, amount) in
    order of slots, none more than ``reach`` after the first. ``path`` has the address that each edge leads to, its amount and its slot.

    Breadth first for all origins at once, as ``joins.cycles``, but each (origin, address) keeps the path on which it is met first: the
    one with the least last slot, then the least path. Addresses met before aren't met again, so a path has at most ``hops`` + 1 edges.
    """
    step = lambda to: F.struct(F.col(to).alias("address"), F.col("a").alias("amount"), F.col("s").alias("slot"))
    e = cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("slot").alias("s"), F.col("amount").alias("a")).filter("u <> v"))
    first = F.min("s").alias("first")
    front = e.groupBy(F.col("u").alias("origin"), F.col("v").alias("at")).agg(F.min(F.struct(F.col("s").alias("slot"), F.array(step("v")).alias("path"))).alias("m"))
    front = front.join(e.groupBy(F.col("u").alias("origin")).agg(first), "origin")
    front = cut(front.select("origin", "at", "m.slot", "m.path", "first"))
    seen, found = front.select("origin", F.col("at").alias("addr")), None
    for hop in range(1, hops + 1):
        last = F.col("first") + reach
        going, in_time = front.filter(F.col("slot") <= last), (F.col("s") >= F.col("slot")) & (F.col("s") <= last)
        best = F.min(F.struct(F.col("s").alias("slot"), F.concat("path", F.array(step("v"))).alias("path"))).alias("m")
        # edges back to the origin first: an origin that they reach goes no further
        home = going.join(e, (F.col("at") == F.col("u")) & (F.col("origin") == F.col("v"))).filter(in_time)
        back = cut(home.groupBy("origin").agg(best).select("origin", F.lit(hop + 1).alias("cycle_length"), "m.path"))
        found = back if found is None else found.unionByName(back)
        if hop == hops:
            break
        onward = going.join(back.select("origin"), "origin", "left_anti").join(e, F.col("at") == F.col("u")).filter(in_time)
        met = onward.groupBy("origin", F.col("v").alias("at")).agg(best, F.min("first").alias("first"))
        rest = met.join(seen.withColumnRenamed("addr", "at"), ["origin", "at"], "left_anti")
        front = cut(rest.select("origin", "at", "m.slot", "m.path", "first"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("origin", F.col("at").alias("addr")))
    return found


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x.cast("double"))


def cycle_features(paths: DataFrame) -> DataFrame:
    """origin and what ``scorers.circular`` reads of a path, but for how often the origin did so before."""
    amounts, slots, n = F.transform("path", lambda p: p["amount"].cast("double")), F.transform("path", lambda p: p["slot"]), F.size("path")
    rows = paths.withColumns({"_amounts": amounts, "_slots": slots, "_mean": _sum(amounts) / n, "_who": F.concat(F.array("origin"), F.transform("path", lambda p: p["address"]))})
    squares = _sum(F.transform("_amounts", lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))))
    spread = F.sqrt(squares / (n - 1)) / F.col("_mean")
    start, end = F.element_at("_amounts", 1), F.element_at("_amounts", -1)
    kinds, total = F.array_distinct("_who"), F.size("_who")
    share = lambda a: F.size(F.filter("_who", lambda b: a == b)) / total
    bits = -_sum(F.transform(kinds, lambda a: share(a) * F.log2(share(a))))
    span = F.array_max("_slots") - F.array_min("_slots")
    gaps = F.filter(F.zip_with(F.slice("_slots", 2, n), F.slice("_slots", F.lit(1), n - 1), lambda b, a: b - a), lambda d: d > 0)
    limit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return rows.select(
        "origin", F.col("cycle_length").alias("length"), F.round(F.when(F.col("_mean") > 0, limit(1 - spread)).otherwise(0.0), 4).alias("similarity"),
        F.round(F.when(start > 0, F.greatest(start - end, F.lit(0.0)) / start).otherwise(1.0), 4).alias("net_loss"),
        F.round(F.when(F.size(kinds) > 1, bits / F.log2(F.size(kinds))).otherwise(0.0), 4).alias("entropy"), ((start > 0) & (start % ADA == 0)).alias("round_amount"),
        F.round(F.when(span > 0, limit(F.col("cycle_length") / F.nullif(span, F.lit(0)))).otherwise(1.0), 4).alias("temporal"),
        F.round(F.when(F.size(gaps) > 0, _sum(gaps) / F.nullif(F.size(gaps), F.lit(0))).otherwise(float(HOP_SLOTS)), 2).alias("hop_slots"),
    )


def circular_scores(edges: DataFrame, history: DataFrame | None = None, hops: int = 6, reach: int = 86_400) -> DataFrame:
    """The features of each origin's cycle and its ``circular`` result. ``history`` (origin, recurrence) tells how many earlier
    transactions of an origin scored HIGH or more; an origin that it has not did so never."""
    rows = cycle_features(cycle_paths(edges, hops, reach))
    rows = rows.withColumn("recurrence", F.lit(0)) if history is None else rows.join(history.select("origin", "recurrence"), "origin", "left").withColumn("recurrence", F.coalesce("recurrence", F.lit(0)))
    names = ("length", "net_loss", "similarity", "recurrence", "entropy", "round_amount", "temporal", "hop_slots")
    return rows.withColumn("circular", scorers.circular({k: F.col(k) for k in names} | {"fee_ratio": F.lit(FEE_RATIO)}))


def as_of_mean(swaps: DataFrame, pool: str, at: str, rate: str, reach: int, out: str) -> DataFrame:
    """Each swap with the mean rate of its pool's swaps from ``reach`` before it up to, and without, its own time; null where
    there are none. A pool's swaps are put in order within two stretches of time at once, so that a pool of any size is dealt."""
    width = max(1, reach)
    instants = swaps.groupBy(pool, at).agg(F.sum(F.col(rate).cast("decimal(28,6)")).alias("_sum"), F.count(rate).alias("_n")).withColumn("_time", F.floor(F.col(at) / width))
    both = instants.withColumn("_of", F.explode(F.array(F.col("_time"), F.col("_time") + 1)))
    w = W.partitionBy(pool, "_of").orderBy(at).rangeBetween(-reach, -1)
    mean = F.sum("_sum").over(w).cast("double") / F.nullif(F.sum("_n").over(w), F.lit(0))
    return swaps.join(both.withColumn(out, mean).filter("_of = _time").select(pool, at, out), [pool, at], "left")


def _most_profitable(victims: DataFrame, gaps: DataFrame, reach: int) -> DataFrame:
    """victim and the best gap around it within ``reach`` on both sides, for victims that have one, by _group and _time.

    Victims in order, a gap's are neighbours, and none is of its own actor, whose rows follow each other. The gaps take what is left of
    theirs, best first, so that a stretch costs as many steps as it has victims and gaps; pairs of both aren't made.
    """
    fields = ["actor", "before", "after", "span", "profit", "_unknown", "price_impact"]
    kinds = dict(victims.dtypes) | dict(gaps.dtypes)

    def one(v: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_unknown", "profit", "actor"], ascending=[True, False, True], kind="stable")
        n, m = len(v), len(g)
        at, row = (pd.factorize(pd.concat(c, ignore_index=True), sort=True)[0].astype(np.int64) for c in ((v["_at"], g["_from"], g["_to"]), (v["victim"], g["before"], g["after"])))
        place = at * (row.max(initial=0) + 2) + row + 1
        order = np.argsort(place[:n], kind="stable")
        mine, times = place[:n][order], v["_at"].to_numpy()[order]
        first = np.maximum(np.searchsorted(mine, place[n : n + m], "right"), np.searchsorted(times, g["_to"].to_numpy() - reach, "left")).tolist()
        last = np.minimum(np.searchsorted(mine, place[n + m :], "left"), np.searchsorted(times, g["_from"].to_numpy() + reach, "right")).tolist()
        free, taken = list(range(n + 1)), np.full(n, -1)  # free: the next victim without a gap, by steps

        def next_free(i: int) -> int:
            while free[i] != i:
                free[i] = free[free[i]]
                i = free[i]
            return i

        for k in range(m):
            i = next_free(first[k]) if first[k] < last[k] else n
            while i < last[k]:
                taken[i], free[i] = k, i + 1
                i = next_free(i + 1)
        hit = np.flatnonzero(taken >= 0)
        out = g[fields].iloc[taken[hit]].reset_index(drop=True)
        out.insert(0, "victim", v["victim"].to_numpy()[order][hit])
        return out

    gaps = gaps.select(F.col("_group").alias("_g"), F.col("_time").alias("_t"), "_from", "_to", *fields)
    return victims.groupBy("_group", "_time").cogroup(gaps.groupBy("_g", "_t")).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in ["victim", *fields]))


def sandwich_scores(legs: DataFrame, reach: int, rates_reach: int) -> DataFrame:
    """For each victim the bracket that earned most, of equal ones the least actor's: victim, actor, before, after, what
    ``scorers.sandwich`` reads, and its result.

    ``legs`` has a row for each transaction of a pool: tx, pool, actor (who put in its first input), at (slot), net (what the actor
    got less what it gave, over all of the transaction), rate (of the swap), is_script (whether the actor is a script, which moves a pool's
    own funds and is no attacker). Profit is the net of both legs; the actor's earlier transactions are counted; rates are held against
    the mean of the pool's swaps in ``rates_reach`` slots before each.
    """
    known = as_of_mean(legs, "pool", "at", "rate", rates_reach, "baseline").withColumn("off", F.abs(F.col("rate") - F.col("baseline")) / F.nullif(F.col("baseline"), F.lit(0.0)))
    wallets = legs.filter(~F.col("is_script")).select("actor").distinct()
    side = lambda name, *cols: known.select(F.col("tx").alias(name), *[F.col(a).alias(b) for a, b in cols]).dropDuplicates([name])
    victims, gaps = victims_and_gaps(legs, "pool", "actor", "at", "tx", reach)
    gaps = gaps.join(wallets, "actor").select("_group", "_time", "actor", F.col("p.at").alias("_from"), F.col("q.at").alias("_to"), F.col("p.row").alias("before"), F.col("q.row").alias("after"))
    gaps = gaps.join(side("before", ("net", "_a"), ("off", "price_impact")), "before").join(side("after", ("net", "_b")), "after")
    gaps = gaps.withColumns({"profit": F.coalesce(F.col("_a") + F.col("_b"), F.lit(0)), "_unknown": (F.col("_a") + F.col("_b")).isNull(), "span": F.col("_to") - F.col("_from")}).drop("_a", "_b")
    found = _most_profitable(victims.select("_group", "_time", F.col("v.at").alias("_at"), F.col("v.row").alias("victim")), gaps, reach)
    order = F.struct("_unknown", -F.col("profit"), "actor")
    known_profit = F.when(~F.col("_unknown"), F.col("profit")).alias("profit")
    best = found.groupBy("victim").agg(F.min_by(F.struct("actor", "before", "after", "span", known_profit, "price_impact"), order).alias("b"))
    rows = best.select("victim", "b.*").join(side("victim", ("at", "_at"), ("off", "rate_delta")), "victim")
    # earlier transactions of the actor: a running count over its instants, looked up at the victim's
    times = legs.select("actor", "at", "tx").distinct().groupBy("actor", "at").agg(F.count(F.lit(1)).alias("_n"))
    asked = rows.select("actor", F.col("_at").alias("at")).distinct().withColumn("_n", F.lit(0).cast("long"))
    until = times.unionByName(asked).groupBy("actor", "at").agg(F.sum("_n").alias("_n"))
    until = until.withColumn("count", F.coalesce(F.sum("_n").over(W.partitionBy("actor").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(until.select("actor", F.col("at").alias("_at"), "count"), ["actor", "_at"])
    f = {"slot_span": F.col("span"), "linked": F.lit(True), "rate_delta": F.coalesce("rate_delta", F.lit(0.0)), "price_impact": F.coalesce("price_impact", F.lit(0.0)), "profit": F.col("profit").cast("double"), "count": F.col("count")}
    return rows.select("victim", "actor", "before", "after", "span", "profit", "count", f["rate_delta"].alias("rate_delta"), f["price_impact"].alias("price_impact"), scorers.sandwich(f).alias("sandwich"))
