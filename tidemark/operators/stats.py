"""Aggregates that need more than one built-in function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

#: Ranges that the values of a key with more than WHOLE rows are cut to when its percentiles are sought.
RANGES, WHOLE = 64, 100_000


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, levels: dict[str, float]) -> DataFrame:
    """keys, a column for each level, and n: the element at place floor(level * n), from 0, of a key's sorted values.

    Nothing is interpolated. The values of a key with WHOLE rows at most are put in order. Those of a larger one aren't gathered:
    approximate quantiles cut them to ranges, counts of the ranges tell in which the places lie, and only distinct values of those
    ranges are ranked. Null values don't count; a key with none has no row.
    """
    return _at_places(df, keys, value, {name: F.floor(F.lit(level) * F.col("n")) for name, level in levels.items()})


def _at_places(df: DataFrame, keys: Sequence[str], value: str, place: dict[str, Column]) -> DataFrame:
    """keys, for each name the element at its place (by ``n``, how many there are) of a key's sorted values, and n."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull())
    if not keys:
        return _by_ranges(rows.select(value, F.lit(0).alias("_key")), value, place).agg(*[F.max(c).alias(c) for c in (*place, "n")])  # one row, of nothing too
    # structs are equal where the same of their fields are null
    rows = rows.select(*keys, value, F.struct(*keys).alias("_key"))
    large = cut(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE).select("_key"))
    if large.isEmpty():
        return _in_order(rows, keys, value, place)
    small, rest = rows.join(F.broadcast(large), "_key", "left_anti"), rows.join(F.broadcast(large), "_key", "left_semi")
    return _in_order(small, keys, value, place).unionByName(_by_ranges(rest, value, place).select("_key.*", *place, "n"))


def _in_order(rows: DataFrame, keys: list[str], value: str, place: dict[str, Column]) -> DataFrame:
    own = W.partitionBy(*keys)
    rows = rows.select(*keys, value, F.row_number().over(own.orderBy(value)).alias("_i"), F.count(F.lit(1)).over(own).alias("n"))
    return rows.groupBy(*keys).agg(*[F.max(F.when(at == F.col("_i") - 1, F.col(value))).alias(name) for name, at in place.items()], F.max("n").alias("n"))


def _by_ranges(rows: DataFrame, value: str, place: dict[str, Column]) -> DataFrame:
    """_key, the element at each place, and n, of few keys with many values each."""
    levels = list(place)
    rows = rows.groupBy("_key", value).agg(F.count(F.lit(1)).alias("_k"))
    cuts = rows.groupBy("_key").agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"), F.sum("_k").alias("n"))
    # approximate quantiles differ with the order in which parts arrive: those that rows are counted by must be those they are ranked by
    rows = rows.join(F.broadcast(cut(cuts)), "_key")
    rows = rows.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    counts = rows.groupBy("_key", "_range").agg(F.sum("_k").alias("_in"), F.max("n").alias("n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_in").over(W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    holds = [(place[n] >= F.col("_before")) & (place[n] < F.col("_before") + F.col("_in")) for n in levels]
    wanted = before.filter(F.array_contains(F.array(*holds), True)).select("_key", "_range", "_before")
    some = rows.join(wanted, ["_key", "_range"])
    upto = F.col("_before") + F.sum("_k").over(W.partitionBy("_key", "_range").orderBy(value))
    some = some.withColumn("_upto", upto)
    picked = [F.max(F.when((place[n] >= F.col("_upto") - F.col("_k")) & (place[n] < F.col("_upto")), F.col(value))).alias(n) for n in levels]
    return some.groupBy("_key").agg(*picked, F.max("n").alias("n"))


def daily_counts(df: DataFrame, at: str, first: Column, last: Column, what: Column | None = None) -> DataFrame:
    """day, n for each day from ``first`` to ``last``, 0 for days without rows. ``what`` is counted distinct."""
    spark = df.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(first), F.to_date(last))).alias("day"))
    n = F.count(F.lit(1)) if what is None else F.countDistinct(what)
    counts = df.groupBy(F.to_date(at).alias("day")).agg(n.alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rank_percentile(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """(mean rank - 1) / (n - 1) of each row's value, 0 for a single row. Ranks come from counts of distinct values, in ranges
    between approximate quantiles, so that no task ranks all values of a key. Null values count as the least and get null."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"), F.sum("_k").alias("_n"))
    cuts = cut(cuts)  # as in ``_by_ranges``
    counts = counts.join(cuts, keys) if keys else counts.crossJoin(F.broadcast(cuts))
    below = F.filter(F.coalesce("_cuts", F.array().cast(cuts.schema["_cuts"].dataType)), lambda c: c < F.col(value))
    counts = counts.withColumn("_range", F.size(below)).drop("_cuts")
    ranges = counts.groupBy(*keys, "_range").agg(F.sum("_k").alias("_in"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_in").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_in")
    inner = F.coalesce(F.sum("_k").over(W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    less, n = F.col("_before") + inner, F.col("_n")
    ranks = counts.join(ranges, [*keys, "_range"]).select(*keys, value, F.when(n > 1, (less + (F.col("_k") - 1) / 2) / (n - 1)).otherwise(0.0).alias(out))
    return df.join(ranks, [*keys, value], "left")


def robust_scale(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Each value less its median, over its interquartile range (1 where that is 0); exact, interpolated quartiles. Nulls don't count
    and stay null; a column of nulls alone stays as it is."""
    out = df
    for c in values:
        q = F.broadcast(quartiles(df, c))  # one row
        spread = F.col("_q3") - F.col("_q1")
        out = out.crossJoin(q).withColumn(c, (F.col(c) - F.col("_q2")) / F.when(spread == 0, 1.0).otherwise(spread)).drop("_q1", "_q2", "_q3")
    return out


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """_q1, _q2, _q3 of a column in one row, null where it has no values: interpolated between the two elements around a quarter's
    place, which are sought as those of ``exact_percentiles``."""
    at = {i: (F.col("n") - 1) * (i / 4) for i in (1, 2, 3)}
    rows = df.select(F.col(value).cast("double").alias("_v"))
    found = _at_places(rows, [], "_v", {f"_{end}{i}": cut(at[i]) for i in at for end, cut in (("low", F.floor), ("high", F.ceil))})
    return found.select(*[(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (at[i] - F.floor(at[i]))).alias(f"_q{i}") for i in at])


def entropy(df: DataFrame, keys: Sequence[str], symbol: str) -> DataFrame:
    """Shannon entropy in bits of the symbols of each key."""
    counts = df.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c")
    return counts.groupBy(*keys).agg((F.log2(n) - F.sum(F.col("_c") * F.log2("_c")) / n).alias("entropy"))
