"""Reads of stored scores, verdicts and states: filters, pages and which of several sources a row comes from."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_filter(
    classes: Collection[str], *, network: str | None = None, bands: Collection[str] = (), cls: str | None = None, min_score: float = 0, corroboration: int = 0, since: Column | None = None, before: Column | None = None
) -> Column:
    """The condition of a list of scores: bands in any letter case, the dominant class, lower bounds where they are above
    0, and times from ``since`` on and earlier than ``before``. An unknown class is an error."""
    if cls is not None and cls not in classes:
        raise ValueError(f"unknown class {cls!r}")
    parts = [F.lit(True)]
    if network is not None:
        parts.append(F.col("network") == network)
    if bands:
        parts.append(F.lower("risk_band").isin([b.lower() for b in bands]))
    if cls is not None:
        parts.append(F.col("max_class") == cls)
    if min_score > 0:
        parts.append(F.col("max_score") >= min_score)
    if corroboration > 0:
        parts.append(F.col("corroboration_count") >= corroboration)
    if since is not None:
        parts.append(F.col("analyzed_at") >= since)
    if before is not None:
        parts.append(F.col("analyzed_at") < before)
    return reduce(Column.__and__, parts)


def page(df: DataFrame, order: Sequence[Column | str], size: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def by_priority(sources: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """The rows of the first source that has a key; columns as the first source's. One row a key and source is assumed."""
    rest = [c for c in sources[0].columns if c not in on]
    every = reduce(DataFrame.unionByName, [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)])
    best = every.groupBy(*on).agg(F.min_by(F.struct(*rest), "_p").alias("_best"))
    return best.select(*on, "_best.*")


def unprocessed(rows: DataFrame, done: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """``rows`` whose key none of ``done`` has; null keys stay."""
    return reduce(lambda df, d: df.join(d.select(*on), list(on), "left_anti"), done, rows)


def since_watermark(rows: DataFrame, at: str, done: DataFrame, done_at: str, overlap: str) -> DataFrame:
    """The rows to look at next: from the newest row done, less an overlap for late ones; all where none is done yet."""
    mark = done.agg((F.max(done_at) - F.expr(f"interval {overlap}")).alias("_mark"))
    return rows.crossJoin(F.broadcast(mark)).filter(F.col("_mark").isNull() | (F.col(at) >= F.col("_mark"))).drop("_mark")


def labels(events: DataFrame, on: Sequence[str], at: str, label: str) -> DataFrame:
    """The newest label of each key; one that was cleared (null) is none."""
    return events.groupBy(*on).agg(F.max_by(label, at).alias(label)).filter(F.col(label).isNotNull())


def resolved_baseline(rows: DataFrame, scope: DataFrame, everywhere: DataFrame, on: str, feature: str, usable: Column, tiers: Collection[str] = ("scope", "global")) -> DataFrame:
    """rows (on, feature) with tier, p50, p99: the scope's own baseline where it is usable and allowed, else the feature's
    everywhere, else tier ``missing`` with 0 and 1. ``usable`` reads s50, s99 and n. Baselines are one row a key."""
    own = scope.select(on, feature, F.col("p50").alias("s50"), F.col("p99").alias("s99"), "n")
    top = everywhere.select(feature, F.col("p50").alias("g50"), F.col("p99").alias("g99"))
    out = rows.join(own, [on, feature], "left").join(top, feature, "left")
    first = F.coalesce(usable, F.lit(False)) & F.lit("scope" in tiers)
    second = F.col("g50").isNotNull() & F.lit("global" in tiers)
    pick = lambda a, b, c: F.when(first, a).when(second, b).otherwise(c)
    return out.select(on, feature, pick(F.lit("scope"), F.lit("global"), F.lit("missing")).alias("tier"), pick(F.col("s50"), F.col("g50"), F.lit(0.0)).alias("p50"), pick(F.col("s99"), F.col("g99"), F.lit(1.0)).alias("p99"))
