import pytest
from pyspark.sql import functions as F

from tests.test_scoring import payload
from tidemark.plans import score
from tidemark.plans.registry import ScorerSpec, Settings, settings


def many_outputs(rows, anchors):
    least = anchors.get("n_outputs", (2, 5))[1]
    return rows.withColumn("many_outputs", F.struct(F.when(F.col("output_count") >= least, 75.0).otherwise(-1.0).alias("score"), F.create_map(F.lit("n"), F.col("output_count").cast("double")).alias("subs")))


SPECS = (*score.SPECS, ScorerSpec("many_outputs", many_outputs, ("n_outputs",)))


def test_a_class_is_added_and_one_switched_off(spark):
    out = {"address": "addr_test1qx", "value": {"lovelace": 5}}
    bait = "URGENT: verify your wallet at claim-ada.top, hurry, claim your reward, limited time"
    raw = spark.createDataFrame([("n", payload(id="many", outputs=[out] * 6)), ("n", payload(id="few", outputs=[out] * 3, metadata=bait))], "network string, raw_data string")
    got = {r.tx_hash: r for r in score.score(raw, SPECS).collect()}
    assert (got["many"].many_outputs, got["many"].max_class, got["many"].risk_band) == (75.0, "many_outputs", "High") and got["few"].many_outputs == -1 and got["few"].phishing > 0
    own = settings({"off": ["phishing"], "anchors": {"many_outputs": {"n_outputs": [1, 3]}}, "bands": [["Critical", 70], ["High", 50]], "corroboration": 90}, SPECS)
    got = {r.tx_hash: r for r in score.score(raw, SPECS, own).collect()}
    assert got["few"].phishing == -1 and got["few"].many_outputs == 75.0 and got["few"].risk_band == "Critical" and got["few"].corroboration_count == 0
    assert "many_outputs" not in score.score(raw).columns


def test_wrong_settings_are_told_all_at_once():
    assert settings({}, score.SPECS) == Settings()
    wrong = {"off": ["nothing"], "anchors": {"phishing": {"url_recipients": [5, 5]}, "large_value": {"size": [1, 2]}, "what": {}}, "bands": [["Critical", 60], ["High", 60]], "corroboration": 101, "more": 1}
    with pytest.raises(ValueError) as e:
        settings(wrong, score.SPECS)
    for part in ("'nothing'", "url_recipients", "'size'", "'what'", "must descend", "101", "'more'"):
        assert part in str(e.value)
    for bands in ([], [["Critical", 120]], [["Critical", 80], ["High", 20]], [["A", 80], ["A", 60]]):
        with pytest.raises(ValueError):
            settings({"bands": bands}, score.SPECS)
