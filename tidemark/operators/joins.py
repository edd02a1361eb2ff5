"""Joins with a shape of their own: shared references, ranges, brackets, hops and overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut


def shared_reference_pairs(df: DataFrame, tx: str, ref: str, at: str, within: float | None = None) -> DataFrame:
    """tx_a, tx_b, shared_count, delta of transactions that share references (collisions); the earlier one is a.

    A join on the reference; ties in time go by id. ``within`` bounds the difference of times: rows of a reference are then
    dealt by time as well, and meet those of their own and the next stretch of it only.
    """
    rows = df.select(tx, ref, at).distinct()
    a = rows.select(F.col(tx).alias("tx_a"), F.col(ref).alias("_ref"), F.col(at).alias("_at_a"))
    b = rows.select(F.col(tx).alias("tx_b"), F.col(ref).alias("_ref"), F.col(at).alias("_at_b"))
    earlier = (F.col("_at_a") < F.col("_at_b")) | ((F.col("_at_a") == F.col("_at_b")) & (F.col("tx_a") < F.col("tx_b")))
    on = ["_ref"]
    if within:
        stretch = lambda c: F.floor(F.col(c).cast("double") / (2 * within))
        a = a.withColumn("_time", F.explode(F.array(stretch("_at_a"), stretch("_at_a") + 1)))
        b, on = b.withColumn("_time", stretch("_at_b")), ["_ref", "_time"]
    met = a.join(b, on).filter(earlier & (F.col("tx_a") != F.col("tx_b")))
    delta = F.col("_at_b").cast("double") - F.col("_at_a").cast("double")
    if within is not None:
        met = met.filter(delta <= within)
    return met.groupBy("tx_a", "tx_b").agg(F.count(F.lit(1)).alias("shared_count"), F.max(delta).alias("delta"))


def range_neighbours(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, reach: int) -> DataFrame:
    """Pairs with equal ``on`` whose places differ by ``reach`` at most. Places are cut to buckets of that width and a left
    row is sent to its own and both next buckets, so the join is one of equality."""
    width = max(1, reach)
    bucket = F.floor(F.col(left_at) / width)
    spread = left.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    met = spread.join(right.withColumn("_bucket", F.floor(F.col(right_at) / width)), [*on, "_bucket"])
    return met.filter(F.abs(F.col(left_at) - F.col(right_at)) <= reach).drop("_bucket")


def victims_and_gaps(df: DataFrame, group: str, actor: str, at: str, row: str, reach: int) -> tuple[DataFrame, DataFrame]:
    """Rows (_own, v) and gaps (actor, p, q) of each _group and stretch (_time) of twice ``reach``; v, p and q have ``at`` and ``row``. A gap is between
    rows of an actor that follow each other, no more than twice ``reach`` apart, and is in all stretches that it touches."""
    width = max(1, 2 * reach)
    rows = df.select(F.col(group).alias("_group"), F.col(actor).alias("actor"), F.struct(F.col(at).alias("at"), F.col(row).alias("row")).alias("p")).distinct()
    rows = rows.filter("actor IS NOT NULL AND p.at IS NOT NULL").withColumn("_time", F.floor(F.col("p.at") / width))
    both = rows.withColumn("_of", F.explode(F.array(F.col("_time"), F.col("_time") - 1)))
    after = F.lead("p").over(W.partitionBy("_group", "actor", "_of").orderBy("p"))
    gaps = both.withColumn("q", after).filter((F.col("_of") == F.col("_time")) & (F.col("q.at") - F.col("p.at") <= 2 * reach))
    gaps = gaps.select("_group", "actor", "p", "q", F.explode(F.array_distinct(F.array(F.col("_time"), F.floor(F.col("q.at") / width)))).alias("_time"))
    return rows.select("_group", "_time", F.col("actor").alias("_own"), F.col("p").alias("v")), gaps


def brackets(df: DataFrame, group: str, actor: str, at: str, row: str, reach: int) -> DataFrame:
    """For each row (the victim) and each other actor with rows on both sides of it in the group within ``reach``: the last
    before and the first after. Columns: victim, actor, before, after, span. ``row`` tells rows apart.

    Rows of an actor that follow each other make a gap, and gaps are joined with the rows inside them, so only brackets leave
    the join. No gap is wider than twice ``reach``: rows are cut to stretches of that width, and an actor's rows are put in
    order within two stretches at a time.
    """
    victims, gaps = victims_and_gaps(df, group, actor, at, row, reach)
    met = victims.join(gaps, ["_group", "_time"]).filter(
        (F.col("actor") != F.col("_own")) & (F.col("v") > F.col("p")) & (F.col("v") < F.col("q")) & (F.col("v.at") - F.col("p.at") <= reach) & (F.col("q.at") - F.col("v.at") <= reach)
    )
    return met.select(F.col("v.row").alias("victim"), "actor", F.col("p.row").alias("before"), F.col("q.row").alias("after"), (F.col("q.at") - F.col("p.at")).alias("span"))


#: Stretches of time that a key's rows are dealt by.
STRETCHES = 1_000


def _stretched(rows: DataFrame, at: str, of: DataFrame, of_at: str) -> DataFrame:
    """``rows`` with ``_time``: which of STRETCHES equal parts of the time that ``of`` spans a row is in, the first or last for one beyond."""
    ends = F.broadcast(of.agg(F.min(F.col(of_at).cast("double")).alias("_lo"), F.max(F.col(of_at).cast("double")).alias("_hi")))
    part = (F.col(at).cast("double") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
    time = F.greatest(F.lit(0), F.least(F.lit(STRETCHES - 1), F.floor(part * STRETCHES).cast("int")))
    return rows.crossJoin(ends).withColumn("_time", time).drop("_lo", "_hi")


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, tiebreak: str) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time; of equal ones the later, then the larger id.
    Rows without a time meet nothing, and left rows that meet nothing are left out.

    No pairs are made: the last right row up to a left row and the first from it on are found by running values. A key's rows
    are dealt by STRETCHES of time, and what the other stretches of a key hold is carried in as their first and last row.
    """
    on = list(on)
    seen = right.filter(F.col(right_at).isNotNull()).groupBy(*on, right_at).agg(F.max(tiebreak).alias(tiebreak))
    mine = left.filter(F.col(left_at).isNotNull()).select(*on, F.col(left_at).alias("_at"), F.struct(*left.columns).alias("_left"))
    theirs = seen.select(*on, F.col(right_at).alias("_at"), F.struct(right_at, tiebreak).alias("_r"))
    rows = _stretched(mine.unionByName(theirs, allowMissingColumns=True), "_at", seen, right_at)
    stretches = rows.groupBy(*on, "_time").agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"))
    w = W.partitionBy(*on)
    carried = stretches.select(
        *on, "_time", F.last("_last", True).over(w.orderBy("_time").rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", True).over(w.orderBy(F.desc("_time")).rowsBetween(W.unboundedPreceding, -1)).alias("_after"),
    )
    w = W.partitionBy(*on, "_time")
    up = F.last("_r", True).over(w.orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow))
    down = F.last("_r", True).over(w.orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumns({"_up": up, "_down": down}).filter("_left IS NOT NULL").join(carried, [*on, "_time"])
    rows = rows.withColumns({"_up": F.coalesce("_up", "_before"), "_down": F.coalesce("_down", "_after")})
    gap = lambda c: F.abs(F.col("_at").cast("double") - F.col(f"{c}.{right_at}").cast("double"))
    best = F.when(F.col("_up").isNull() | (gap("_down") <= gap("_up")), F.col("_down")).otherwise(F.col("_up"))
    return rows.select("_left.*", best.alias("nearest")).filter("nearest IS NOT NULL")


def cycles(edges: DataFrame, start: str = "src", end: str = "dst", at: str = "slot", hops: int = 6, reach: int = 86_400, rows_a_hop: int | None = None) -> DataFrame:
    """origin, cycle_length, slot: the shortest way that money returns to each origin, along edges in time order.

    Breadth first for all origins at once: a frontier of (origin, address) with the least slot, joined with the edges hop
    by hop; an origin that was reached again leaves, and addresses met before are not met again. cycle_length is hops + 1,
    as a return on the first onward hop is a cycle of two. Only edges back to the origin are met first, so that an origin that
    they reach makes no other rows; of the others an address is written once a hop, whatever the number of ways to it.
    """
    e = cut(edges.select(F.col(start).alias("u"), F.col(end).alias("v"), F.col(at).alias("s")).filter("u <> v"))
    front = e.groupBy(F.col("u").alias("origin"), F.col("v").alias("at")).agg(F.min("s").alias("slot"))
    front = cut(front.join(front.groupBy("origin").agg(F.min("slot").alias("first")), "origin"))
    seen, found = front.select("origin", F.col("at").alias("addr")), None
    for hop in range(1, hops + 1):
        # no edge goes on from a place met after the reach
        going, in_time = front.filter(F.col("slot") <= F.col("first") + reach), (F.col("s") >= F.col("slot")) & (F.col("s") <= F.col("first") + reach)
        if rows_a_hop is not None:
            step = going.join(e, F.col("at") == F.col("u")).filter(in_time)
            step = step.withColumn("_n", F.row_number().over(W.partitionBy("origin").orderBy("s", "u", "v"))).filter(F.col("_n") <= rows_a_hop).drop("_n")
            step = cut(step.select("origin", "v", "s", "first"))
            home = step.filter("v = origin")
        else:
            home = going.join(e, (F.col("at") == F.col("u")) & (F.col("origin") == F.col("v"))).filter(in_time)
        back = cut(home.groupBy("origin").agg(F.min("s").alias("slot")).select("origin", F.lit(hop + 1).alias("cycle_length"), "slot"))
        if rows_a_hop is None:
            step = going.join(back.select("origin"), "origin", "left_anti").join(e, F.col("at") == F.col("u")).filter(in_time)
        found = back if found is None else found.unionByName(back)
        if hop == hops:
            break
        onward = step.join(back.select("origin"), "origin", "left_anti").groupBy("origin", F.col("v").alias("at")).agg(F.min("s").alias("slot"), F.min("first").alias("first"))
        front = cut(onward.join(seen.withColumnRenamed("addr", "at"), ["origin", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("origin", F.col("at").alias("addr")))
    return found


#: Rows with so many items at most take their items along to where they meet others.
SMALL = 64


def jaccard_pairs(df: DataFrame, row: str, item: str, least: float) -> DataFrame:
    """a, b, common, similarity of rows that share items, by an inverted join: pairs that share nothing are never made.

    Where ``least`` is above 0, rows of SMALL items at most have their items with them: a pair is judged at its first common item, so
    that only pairs that are similar enough leave the join. Pairs with a larger row are counted over their items.
    """
    rows = df.select(row, item).filter(F.col(row).isNotNull()).repartition(F.col(row)).distinct()
    sizes = rows.groupBy(row).agg(F.count(F.lit(1)).alias("n"))
    if least <= 0:
        return _counted_pairs(rows, sizes, row, item, least)
    large = cut(sizes.filter(F.col("n") > SMALL).select(row))
    some = not large.isEmpty()
    own = (rows.join(F.broadcast(large), row, "left_anti") if some else rows).groupBy(row).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
    posts = own.select(F.col(row).alias("r"), "n", "items", F.explode("items").alias("_item"))
    side = lambda s: posts.select(F.col("r").alias(s), F.col("n").alias(f"n{s}"), F.col("items").alias(f"i{s}"), "_item")
    shared = F.array_intersect("ia", "ib")  # in the order of the first
    met = side("a").join(side("b"), "_item").filter((F.col("a") < F.col("b")) & (F.get(shared, F.lit(0)) == F.col("_item")))
    met = met.select("a", "b", F.size(shared).cast("long").alias("common"), "na", "nb")
    similarity = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    found = met.select("a", "b", "common", similarity.alias("similarity")).filter(F.col("similarity") >= least)
    return found.unionByName(_counted_pairs(rows, sizes, row, item, least, large)) if some else found


def _counted_pairs(rows: DataFrame, sizes: DataFrame, row: str, item: str, least: float, large: DataFrame | None = None) -> DataFrame:
    """As ``jaccard_pairs``, of all rows or of pairs with a row of ``large``."""
    if large is not None:
        rows = rows.join(F.broadcast(large.withColumn("_large", F.lit(True))), row, "left")
    else:
        rows = rows.withColumn("_large", F.lit(True))
    one_large = F.coalesce("_la", "_lb", F.lit(False))
    a = rows.select(F.col(row).alias("a"), item, F.col("_large").alias("_la"))
    b = rows.select(F.col(row).alias("b"), item, F.col("_large").alias("_lb"))
    common = a.join(b, item).filter((F.col("a") < F.col("b")) & one_large).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    out = common.join(sizes.select(F.col(row).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(row).alias("b"), F.col("n").alias("nb")), "b")
    similarity = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return out.select("a", "b", "common", similarity.alias("similarity")).filter(F.col("similarity") >= least)


def with_marker(left: DataFrame, right: DataFrame, on: Sequence[str], marker: str) -> DataFrame:
    """``left`` with a boolean: whether ``right`` has its key."""
    return left.join(right.select(*on).distinct().withColumn(marker, F.lit(True)), list(on), "left").withColumn(marker, F.coalesce(marker, F.lit(False)))


def last_matching_rule(df: DataFrame, rules: DataFrame, match: Column, key: str) -> DataFrame:
    """Each row with its last matching rule (rule_index, action); rules are a small table of configuration."""
    met = df.join(F.broadcast(rules), match, "left")
    return met.groupBy(key).agg(F.max_by("action", "rule_index").alias("action"))


def seen_before(df: DataFrame, actor: str, at: str, counts: Column, name: str) -> DataFrame:
    """Each row with how many rows of its actor that ``counts`` marks are earlier in time (not at the same time).

    Rows of an instant are added up first; a running sum over an actor's instants then takes the place of pairs. An actor's instants
    are dealt by STRETCHES of time, whose sums are carried from one to the next. Rows without an actor or time are left out.
    """
    instants = _stretched(df.filter(F.col(at).isNotNull()).groupBy(actor, at).agg(F.count_if(counts).alias("_n")), at, df, at)
    earlier = lambda c, keys, order: F.coalesce(F.sum(c).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = instants.groupBy(actor, "_time").agg(F.sum("_n").alias("_n")).select(actor, "_time", earlier("_n", [actor], "_time").alias("_before"))
    within = instants.select(actor, at, "_time", earlier("_n", [actor, "_time"], at).alias("_within"))
    before = within.join(carried, [actor, "_time"]).select(actor, at, (F.col("_before") + F.col("_within")).alias(name))
    return df.join(before, [actor, at])


def earlier_in_range(df: DataFrame, actor: str, at: str, reach: int) -> DataFrame:
    """Each row with ``earlier``: rows of its actor, itself included, at most ``reach`` before it or at the same time. An actor's
    instants are put in order within two stretches of ``reach`` at once. Rows without an actor or time are left out."""
    instants = df.groupBy(actor, at).agg(F.count(F.lit(1)).alias("_n")).withColumn("_time", F.floor(F.col(at) / max(1, reach)))
    both = instants.withColumn("_of", F.explode(F.array(F.col("_time"), F.col("_time") + 1)))
    w = W.partitionBy(actor, "_of").orderBy(at).rangeBetween(-reach, W.currentRow)
    counted = both.withColumn("earlier", F.sum("_n").over(w)).filter("_of = _time")
    return df.join(counted.select(actor, at, "earlier"), [actor, at])
