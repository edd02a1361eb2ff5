"""Reports of a period: how many alerts of which band and class, the worst of them, and their rows as a table for export."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.reads import page

#: Bands from the lowest on.
ORDER = ("Informational", "Moderate", "High", "Critical")
#: The class of findings that no scorer stores.
ANOMALY = "contract_anomaly"
LOVELACE = 1_000_000


def bands_from(least: str) -> tuple[str, ...]:
    """``least`` and the bands above it; all for a name that is no band."""
    return ORDER[ORDER.index(least) :] if least in ORDER else ORDER


def _alerts(scores: DataFrame, since: Column, before: Column, least: str, classes: Collection[str] | None) -> DataFrame:
    rows = scores.filter((F.col("analyzed_at") >= since) & (F.col("analyzed_at") < before) & F.col("risk_band").isin(*bands_from(least)))
    return rows if classes is None else rows.filter(F.col("max_class").isin(*classes))


def found_anomalies(verdicts: DataFrame, since: Column, before: Column, least: str) -> DataFrame:
    """tx_hash, score, risk_band, scored_at of a period's findings. A transaction has a row of ``verdicts`` (score, risk_band, scored_at,
    published_at) for each contract it touched, and counts by the worst, of equal ones the one scored first. It belongs to the period if
    that one was scored in it or any of its rows was published in it, as a label may have been put on long after."""
    inside = lambda c: F.coalesce((F.col(c) >= since) & (F.col(c) < before), F.lit(False))
    worst = F.max_by(F.struct("score", "risk_band", "scored_at"), F.struct("score", -F.unix_micros(F.col("scored_at").cast("timestamp")), "risk_band"))
    each = verdicts.groupBy("tx_hash").agg(worst.alias("w"), F.bool_or(inside("published_at")).alias("_p")).select("tx_hash", "w.*", "_p")
    return each.filter((inside("scored_at") | F.col("_p")) & F.col("risk_band").isin(*bands_from(least))).drop("_p")


def summary(scores: DataFrame, archived: DataFrame, verdicts: DataFrame, since: Column, before: Column, every: Sequence[str], least: str = "Moderate", classes: Collection[str] | None = None) -> DataFrame:
    """section, name, n of a period: ``total`` scored; each ``band``; each ``class`` of ``every`` by its alerts of band ``least`` or above, 0
    for those that ``classes`` leave out; findings as ``contract_anomaly`` among the classes alone, as their transactions are in the bands
    already; ``archived`` (archived_at) as false positives. What didn't occur is 0."""
    scope = set(every) | {ANOMALY} if classes is None else set(classes)
    window = scores.filter((F.col("analyzed_at") >= since) & (F.col("analyzed_at") < before))
    worst = F.col("risk_band").isin(*bands_from(least))
    # one pass over the period's scores
    cells = [("total", "scored", F.count(F.lit(1)))] + [("band", b, F.count_if(F.col("risk_band") == b)) for b in reversed(ORDER)]
    cells += [("class", c, F.count_if(worst & (F.col("max_class") == c)) if c in scope else F.lit(0)) for c in every]
    counted = window.agg(*[n.cast("long").alias(f"_{i}") for i, (_, _, n) in enumerate(cells)])
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(name).alias("name"), F.col(f"_{i}").alias("n")) for i, (s, name, _) in enumerate(cells)])).alias("r")).select("r.*")
    one = lambda df, section, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), F.lit(name).alias("name"), "n")
    found = found_anomalies(verdicts, since, before, least)
    away = archived.filter((F.col("archived_at") >= since) & (F.col("archived_at") < before))
    return rows.unionByName(one(found if ANOMALY in scope else found.limit(0), "class", ANOMALY)).unionByName(one(away, "archived", "false_positives"))


def worst(scores: DataFrame, verdicts: DataFrame, since: Column, before: Column, least: str = "Moderate", classes: Collection[str] | None = None, most: int = 10) -> DataFrame:
    """The ``most`` worst alerts of a period (tx_hash, attack_class, risk_score, risk_band, at) of stored classes and findings alike. Each
    source is cut to as many before they meet, so that none pushes the other out; equal scores go by class, then key."""
    cols = lambda df, c, s, at: df.select("tx_hash", c.alias("attack_class"), F.col(s).alias("risk_score"), "risk_band", F.col(at).alias("at"))
    order = [F.desc("risk_score"), "attack_class", "tx_hash"]
    rows = page(cols(_alerts(scores, since, before, least, classes), F.col("max_class"), "max_score", "analyzed_at"), order, most)
    if classes is None or ANOMALY in classes:
        rows = rows.unionByName(page(cols(found_anomalies(verdicts, since, before, least), F.lit(ANOMALY), "score", "scored_at"), order, most))
    return page(rows, order, most)


def export(scores: DataFrame, since: Column, before: Column, every: Sequence[str], least: str = "Moderate", classes: Collection[str] | None = None) -> DataFrame:
    """A row for each alert of a period as it is exported: fee in whole coins, a score for each class of ``every`` (-1 where it has none),
    the parts of the dominant class as JSON. ``scores`` has fee, output_count, the classes' columns, ``sub_scores`` (class -> part -> value) and
    analysis_version besides; unknown fees and counts stay null, which CSV shows as empty."""
    rows = _alerts(scores, since, before, least, classes)
    subs = F.coalesce(F.to_json(F.try_element_at("sub_scores", F.col("max_class"))), F.lit("{}"))
    return rows.select(
        "tx_hash", "analyzed_at", "network", F.coalesce("max_class", F.lit("")).alias("max_class"), "max_score", "risk_band", (F.col("fee") / LOVELACE).cast("double").alias("fee_ada"), "output_count",
        *[F.coalesce(c, F.lit(-1.0)).alias(f"score_{c}") for c in every], subs.alias("sub_scores"), "analysis_version",
    )


def write_export(rows: DataFrame, path: str) -> None:
    """The rows of ``export`` by falling score as CSV with a header; files in order, each a range of scores."""
    rows.orderBy(F.desc("max_score"), "tx_hash").write.mode("overwrite").option("header", True).csv(path)
