"""Baselines measured from features, held against the ones in use, and written with a log of what drifted."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.operators import stats
from tidemark.operators.versions import latest_by_key
from tidemark.sources.store import Store

KEY = ("network", "scope_type", "scope_id", "feature")
LEVELS = {"p50": 0.5, "p99": 0.99}
GLOBAL = "global"


def measured(rows: DataFrame, network: str, scope_type: str, features: Sequence[str], now: Column, scope: str | None = None, least: int = 1) -> DataFrame:
    """A baseline of each feature and scope (a column of ``rows``; all rows are one without it) with ``least`` samples: exact percentiles of
    the values that aren't null, all features in one pass."""
    own = rows.select((F.lit(GLOBAL) if scope is None else F.col(scope).cast("string")).alias("scope_id"), *[F.col(f).cast("double").alias(f) for f in features])
    long = own.unpivot("scope_id", list(features), "feature", "value").filter("scope_id is not null")
    out = stats.exact_percentiles(long, ["scope_id", "feature"], "value", LEVELS).filter(F.col("n") >= least)
    return out.select(F.lit(network).alias("network"), F.lit(scope_type).alias("scope_type"), "scope_id", "feature", "p50", "p99", F.col("n").alias("sample_count"), now.alias("computed_at"))


def decided(current: DataFrame, fresh: DataFrame, two_way: Collection[str] = ()) -> DataFrame:
    """``fresh`` with the values in use (old_p50, old_p99; null where there are none), which of its axes drifted, and whether it is held.

    It is held where an axis drifts the way that hides attacks: up, or either way for features in ``two_way``, which some
    class reads inverted. A 99th percentile of 0 protects nothing and never holds; a first baseline always passes.
    """
    old = current.select(*KEY, F.col("p50").alias("old_p50"), F.col("p99").alias("old_p99"))
    rows = fresh.join(old, list(KEY), "left")
    both = F.col("feature").isin(*two_way) if two_way else F.lit(False)

    def axis(name: str) -> tuple[Column, Column]:
        was, now = F.col(f"old_{name}"), F.col(name)
        drifted = F.coalesce(F.when(was == 0, now > 0).otherwise(S.drift(was, now) > S.DRIFT), F.lit(False))
        return drifted, drifted & ((now > was) | both)

    (d50, h50), (d99, h99) = axis("p50"), axis("p99")
    return rows.withColumns({"drifted_p50": d50, "drifted_p99": d99, "held": h50 | (h99 & (F.col("old_p99") > 0))})


def drift_events(rows: DataFrame) -> DataFrame:
    """A row for each axis that drifted in ``decided`` rows, held or applied."""
    event = lambda a: F.when(F.col(f"drifted_{a}"), F.struct(F.lit(a).alias("axis"), F.col(f"old_{a}").alias("old_value"), F.col(a).alias("new_value")))
    each = rows.select(*KEY, "held", "computed_at", F.explode(F.array_compact(F.array(event("p50"), event("p99")))).alias("e")).select(*KEY, "held", "computed_at", "e.*")
    return each.select(*KEY, "axis", "old_value", "new_value", S.drift(F.col("old_value"), F.col("new_value")).alias("drift_ratio"), (~F.col("held")).alias("applied"), F.col("computed_at").alias("detected_at"))


def recompute(store: Store, fresh: DataFrame, batch: int, two_way: Collection[str] = ()) -> None:
    """Writes the baselines of ``fresh`` that aren't held, as batch number ``batch``, and the drifts of all. Held against the batches before
    it only, so a batch that is written again has the same rows, whichever of its tables were there already."""
    current = latest_by_key(store.rows("baselines").filter(F.col("batch") < batch), KEY, "computed_at", ["batch"])
    rows = decided(current, fresh, two_way).persist()
    try:
        store.put("baseline_drift_events", drift_events(rows), batch, F.to_date("detected_at"))
        store.put("baselines", rows.filter(~F.col("held")), batch)
    finally:
        rows.unpersist()
