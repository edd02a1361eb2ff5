"""Append-only tables read as their newest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import TABLES


def latest_by_key(df: DataFrame, key: Sequence[str], version: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key; ties go to the largest ``tiebreak``. An aggregate, so versions are merged before they
    are shuffled and a key with very many versions isn't gathered. Must come before joins and before filters on columns
    that aren't in the key."""
    rest = [c for c in df.columns if c not in key]
    order = F.struct(version, *[c for c in tiebreak if c != version])
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*[F.col(c) if c in key else F.col(f"_row.{c}") for c in df.columns])


def latest(df: DataFrame, table: str) -> DataFrame:
    """The newest rows of a known table."""
    t = TABLES[table]
    return latest_by_key(df, t.key, t.version, [c for c, k in df.dtypes if c not in t.key and not k.startswith("map")])


def first_seen(df: DataFrame, key: str, slot: str) -> DataFrame:
    """Least slot of each key; whatever order rows came in."""
    return df.groupBy(key).agg(F.min(slot).alias("first_slot"))


def without_rolled_back(df: DataFrame, rollbacks: DataFrame, slot: str = "slot", written: str = "ingestion_timestamp") -> DataFrame:
    """Rows that no rollback (network, slot, at) took away: one takes rows of later slots that were written before it.

    Rollbacks are few and are gathered to an array for each network, ordered by time with the least slot of it and all
    later ones, so a row is tested against the first one after it was written.
    """
    each = rollbacks.groupBy("network").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("at"), F.col("slot").alias("s")))).alias("_rb"))
    later = F.filter("_rb", lambda r: (r["at"] > F.col(written)) & (r["s"] < F.col(slot)))
    return df.join(F.broadcast(each), "network", "left").filter(F.coalesce(F.size(later), F.lit(0)) <= 0).drop("_rb")


def without_keys(df: DataFrame, tombstones: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key no tombstone has."""
    return df.join(tombstones.select(*key).distinct(), list(key), "left_anti")


def new_rows(df: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert-if-absent: one row for each key that ``existing`` has not."""
    return df.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti")


def pruned(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Retention: rows not older than ``days``; 0 keeps all."""
    return df if days == 0 else df.filter(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def published(current: DataFrame, fresh: DataFrame, key: Sequence[str], value: str, tombstone: str, now: Column) -> DataFrame:
    """Rows to append so that the newest rows equal ``fresh``: changed and new ones, and ``tombstone`` for keys that went.

    ``published_at`` rises strictly: the later of now and a microsecond after the newest row.
    """
    last = current.agg(F.max("published_at").alias("last"))
    at = F.greatest(now, F.col("last") + F.expr("interval 1 microsecond"))
    old = current.select(*key, F.col(value).alias("_old"))
    put = fresh.select(*key, value).join(old, list(key), "left").filter(~F.col(value).eqNullSafe(F.col("_old"))).drop("_old")
    gone = old.filter(F.col("_old") != tombstone).join(fresh, list(key), "left_anti").select(*key, F.lit(tombstone).alias(value))
    return put.unionByName(gone).crossJoin(F.broadcast(last)).select(*key, value, F.coalesce(at, now).alias("published_at"))
