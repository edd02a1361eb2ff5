import csv
import glob
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.plans import reports

DAY = datetime(2024, 1, 1)
EVERY = ("a", "b", "c")


def at(day):
    return DAY + timedelta(days=day)


def period():
    return F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-05").cast("timestamp_ntz")


def made(spark):
    rows = [("t1", 1, "a", 85.0, "Critical"), ("t2", 2, "a", 40.0, "Moderate"), ("t3", 3, "b", 65.0, "High"), ("t4", 4, "b", 99.0, "Critical"), ("t5", 0, "a", 99.0, "Critical"), ("t6", 1, None, 5.0, "Informational"), ("t7", 2, "c", 85.0, "Critical")]
    scores = spark.createDataFrame([(h, at(d), c, s, b) for h, d, c, s, b in rows], "tx_hash string, analyzed_at timestamp_ntz, max_class string, max_score double, risk_band string")
    verdicts = [
        ("v1", 70.0, "High", 1, 9), ("v1", 90.0, "Critical", 0, 2),  # the worst was scored before the period and published in it
        ("v2", 90.0, "Critical", 0, 0), ("v3", 61.0, "High", 3, None), ("v4", 20.0, "Informational", 2, 2), ("v5", 65.0, "High", 9, 4),
    ]
    found = spark.createDataFrame([(h, s, b, at(x), None if y is None else at(y)) for h, s, b, x, y in verdicts], "tx_hash string, score double, risk_band string, scored_at timestamp_ntz, published_at timestamp_ntz")
    archived = spark.createDataFrame([(at(d),) for d in (0, 1, 3, 4)], "archived_at timestamp_ntz")
    return scores, archived, found


def test_summary_counts_bands_classes_and_findings(spark):
    scores, archived, found = made(spark)
    got = {(r.section, r.name): r.n for r in reports.summary(scores, archived, found, *period(), EVERY, "High").collect()}
    assert got == {
        ("total", "scored"): 5, ("band", "Critical"): 2, ("band", "High"): 1, ("band", "Moderate"): 1, ("band", "Informational"): 1,
        ("class", "a"): 1, ("class", "b"): 1, ("class", "c"): 1, ("class", reports.ANOMALY): 2, ("archived", "false_positives"): 2,
    }
    some = {(r.section, r.name): r.n for r in reports.summary(scores, archived, found, *period(), EVERY, "Moderate", ("a",)).collect()}
    assert some["class", "a"] == 2 and some["class", "b"] == some["class", reports.ANOMALY] == 0 and some["total", "scored"] == 5
    none = reports.summary(scores.limit(0), archived.limit(0), found.limit(0), *period(), EVERY).collect()
    assert len(none) == 10 and all(r.n == 0 for r in none)


def test_the_worst_of_both_sources(spark):
    scores, _, found = made(spark)
    got = [(r.tx_hash, r.attack_class, r.risk_score) for r in reports.worst(scores, found, *period(), "High").collect()]
    assert got == [("v1", reports.ANOMALY, 90.0), ("t1", "a", 85.0), ("t7", "c", 85.0), ("t3", "b", 65.0), ("v3", reports.ANOMALY, 61.0)]
    assert [r.tx_hash for r in reports.worst(scores, found, *period(), "High", ("b", "c"), most=1).collect()] == ["t7"]


def test_export_as_csv(spark, tmp_path):
    scores, _, _ = made(spark)
    subs = F.create_map(F.lit("a"), F.create_map(F.lit("x"), F.lit(0.5)))
    rows = scores.withColumns({"a": F.when(F.col("max_class") == "a", F.col("max_score")), "b": F.lit(None).cast("double"), "c": F.lit(1.5), "network": F.lit("n"), "fee": F.when(F.col("tx_hash") == "t1", 1_500_000), "output_count": F.lit(3), "sub_scores": subs, "analysis_version": F.lit("1")})
    reports.write_export(reports.export(rows, *period(), EVERY), f"{tmp_path}/out")
    got = [r for f in sorted(glob.glob(f"{tmp_path}/out/*.csv")) for r in csv.DictReader(open(f), escapechar="\\")]
    assert [r["tx_hash"] for r in got] == ["t1", "t7", "t3", "t2"]
    assert (got[0]["fee_ada"], got[0]["score_a"], got[0]["score_b"], got[0]["sub_scores"]) == ("1.5", "85.0", "-1.0", '{"x":0.5}')
    assert (got[1]["fee_ada"], got[1]["sub_scores"]) == ("", "{}")
