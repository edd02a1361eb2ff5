import json

from pyspark.sql import functions as F

from tidemark.functions import payload as P
from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.plans import score, scorers


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_normalise_bands_and_ties(spark):
    r = one(spark, a=S.normalise(F.lit(5.0), 0, 10), b=S.normalise(F.lit(5.0), 3, 3), c=S.normalise_inverted(F.lit(5.0), 3, 3), d=S.band(F.lit(30.0)), e=S.band(F.lit(30.01)), f=S.band(F.lit(60.0)), g=S.band(F.lit(80.0)))
    assert abs(r.a - 0.5) < 1e-6 and r.b == r.c == 0 and (r.d, r.e, r.f, r.g) == ("Informational", "Moderate", "High", "Critical")
    top, name = S.first_max([("x", F.lit(-1.0)), ("y", F.lit(7.0)), ("z", F.lit(7.0))])
    n, names = S.corroborating([("z", F.lit(50.0)), ("a", F.lit(40.0)), ("q", F.lit(39.0))])
    assert tuple(one(spark, t=top, n=name, k=n, s=names)) == (7.0, "y", 2, "a,z")


def payload(**more):
    return json.dumps({"id": "t1", "inputs": [{"transaction": {"id": "p"}, "index": 0}], "outputs": [{"address": "addr_test1qx", "value": {"ada": {"lovelace": 2_000_000}}}], "fee": {"ada": {"lovelace": 170_000}}} | more)


def tx(spark, raw):
    return spark.createDataFrame([("n", raw)], "network string, raw_data string").transform(score.parse).first()


def test_failed_script_spends_its_collateral(spark):
    t = tx(spark, payload(spends="collaterals", collaterals=[{"transaction": "c", "index": 1}], references=[{"transaction": {"id": "r"}, "index": 2}], collateralReturn={"address": "addr_test1qy", "value": {"lovelace": 5}}))
    assert not t.script_valid and [i.input_tx_hash for i in t.inputs] == ["p", "r", "c"]
    assert [i.is_unspent_attempt for i in t.inputs] == [True, False, False]
    assert [(o.output_index, o.amount, o.is_collateral) for o in t.outputs] == [(1, 5, True)] and t.input_count == 1 and t.total_output_value == 5


def test_malformed_parts_count_as_nothing(spark):
    t = tx(spark, payload(outputs=[{"address": "a", "value": {"ada": {"lovelace": "x"}, "pol": {"6e": "bad", "6f": 3}}}, {"address": "b", "value": 7}], fee="?", validityInterval={"invalidAfter": 99}))
    assert [int(o.amount) for o in t.outputs] == [0, 7] and t.fee == 0 and t.ttl == 99
    assert tx(spark, "not json").tx_hash is None
    r = one(spark, a=P.assets(F.lit('{"lovelace": 1, "p": {"aa": 5, "bb": 0}, "q": 3}')), b=P.value_bytes(F.lit(30), P.assets(F.lit('{"lovelace": 30}'))))
    assert [(x.policy, x.name, int(x.qty)) for x in r.a] == [("p", "aa", 5), ("p", "bb", 0)] and r.b == 2


def test_redeemers_of_both_shapes(spark):
    a = '[{"validator": {"purpose": "spend"}, "executionUnits": {"memory": 5, "cpu": 7}, "redeemer": "d8"}]'
    b = '{"spend:0": {"redeemer": "d8", "executionUnits": {"memory": 5, "cpu": 7}}}'
    for text in (a, b):
        (r,) = one(spark, r=P.redeemers(F.lit(text))).r
        assert (r.purpose, int(r.memory), int(r.cpu), r.payload) == ("spend", 5, 7, "d8")


def test_links_and_phrases(spark):
    r = one(spark, u=T.urls(F.lit("go hxxps://evil[.]top/x, evil.top and wallet-fix(dot)xyz now")), s=T.social_engineering(F.lit("Enter your SEED phrase")), m=T.social_engineering(F.lit("hurry, claim your free ada")), d=T.registrable(F.lit("a.b.co.uk")), e=T.registrable(F.lit("x.y.org")))
    assert r.u == ["https://evil.top/x", "wallet-fix.xyz"] and r.s == 1.0 and abs(r.m - 0.45) < 1e-9 and (r.d, r.e) == ("b.co.uk", "y.org")


def test_names_that_look_alike(spark):
    r = one(spark, a=T.similarity(F.lit("SUNDAE"), F.lit("SUNDAEX")), b=T.similarity(F.lit(""), F.lit("")), c=T.suspicion(F.lit("СUNDAE")), d=T.skeleton(F.lit("ΑDA​")), e=T.suspicion(F.lit("HOSKY")))
    assert abs(r.a - 12 / 13) < 1e-9 and r.b == 1 and abs(r.c - 0.6) < 1e-9 and r.d == "ada" and r.e == 0


def test_cbor_leaves(spark):
    r = one(spark, a=T.leaf_concentration(F.lit("82" + "43616263" + "01")), b=T.datum_text(F.lit("82" + "43616263" + "01")), c=T.leaf_concentration(F.lit("ff")), d=T.leaf_concentration(F.lit("81" * 70 + "01")), e=T.byte_entropy(F.lit(bytearray(b"aabb"))))
    assert abs(r.a - 0.5) < 1e-9 and r.b == "abc" and r.c == r.d == 0 and r.e == 1


def result(spark, f, scorer, **features):
    return one(spark, r=scorer({k: F.lit(v) for k, v in features.items()})).r.score


def test_every_class_fires_on_its_attack_and_not_without_its_gate(spark):
    fire = lambda scorer, **f: result(spark, f, scorer, **f)
    dust = dict(is_script=True, tokens=40, value_bytes=2000, ada=1.1e6, allowlisted=False, all_known_old=False)
    assert fire(scorers.token_dust, **dust) >= 80 and fire(scorers.token_dust, **dust | {"is_script": False}) == -1 and fire(scorers.token_dust, **dust | {"tokens": 14}) <= 59
    value = dict(is_script=True, tokens=1, digits=19, value_bytes=1600, ada=1.1e6)
    assert fire(scorers.large_value, **value) >= 80 and fire(scorers.large_value, **value | {"tokens": 3}) == -1 and fire(scorers.large_value, **value | {"digits": 5}) <= 30
    datum = dict(datum_bytes=15_000, datum_present=2, entropy=7.0, concentration=0.1, datum_ratio=0.99, value_bytes=50, same_script_bytes=15_000)
    assert fire(scorers.large_datum, **datum) >= 80 and fire(scorers.large_datum, **datum | {"datum_bytes": 100, "datum_present": 1}) == -1
    sat = dict(n_inputs=3, has_redeemer=True, value_in=9e8, value_out=0.0, n_assets_out=0, cpu=1000.0, sender_recurrence=0, allowlisted=False, uniform_redeemers=False, returned=False)
    assert fire(scorers.multiple_sat, **sat) >= 60 and fire(scorers.multiple_sat, **sat | {"n_inputs": 1}) == -1 and fire(scorers.multiple_sat, **sat | {"n_inputs": 12, "uniform_redeemers": True}) <= 59
    run = dict(shared=1, outcome="TX_B_CONFIRMED", delta_ms=100.0, wins=5, fee_gap=0, ttl_gap=0, change_link=True)
    assert fire(scorers.front_running, **run) >= 80 and fire(scorers.front_running, **run | {"wins": 2}) <= 79 and fire(scorers.front_running, **run | {"shared": 0}) == -1
    wich = dict(slot_span=3, linked=True, rate_delta=0.2, price_impact=0.1, profit=6e6, count=6)
    assert fire(scorers.sandwich, **wich) >= 80 and fire(scorers.sandwich, **wich | {"profit": 1000.0}) == -1
    loop = dict(length=4, net_loss=0.001, similarity=0.99, recurrence=6, entropy=0.2, round_amount=True, temporal=0.9, hop_slots=2, fee_ratio=0.01)
    assert fire(scorers.circular, **loop) >= 80 and fire(scorers.circular, **loop | {"length": 2}) == -1
    fake = dict(similarity=0.99, foreign_policy=True, suspicion=0.6, cip25=0.8, critical=True, recipients=200, quantity=1000.0)
    assert fire(scorers.fake_token, **fake) >= 80 and fire(scorers.fake_token, **fake | {"foreign_policy": False}) == -1
    fish = dict(allowlisted=False, has_url=True, blacklisted=True, brand_similarity=0.9, social=1.0, recipients=60, targeting=1.0, bad_tld=True, own_change=False)
    assert fire(scorers.phishing, **fish) >= 80 and fire(scorers.phishing, **fish | {"has_url": False, "social": 0.0}) == -1


def test_payloads_to_class_scores(spark):
    script = "addr_test1wqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq"
    dust = {"ada": {"lovelace": 1_100_000}} | {f"{k:056x}": {f"{k:064x}": 1} for k in range(30)}
    rows = [
        ("n", payload(id="dust", outputs=[{"address": script, "value": dust}])),
        ("n", payload(id="fish", metadata="URGENT: verify your wallet at claim-ada.top, hurry, claim your reward, limited time")),
        ("n", payload(id="sat", inputs=[{"transaction": "p", "index": k, "address": script, "value": {"lovelace": 400_000_000}} for k in range(3)], redeemers=[{"validator": {"purpose": "spend"}, "executionUnits": {"memory": 1, "cpu": 10}, "redeemer": str(k)} for k in range(3)])),
        ("n", payload(id="plain")),
        ("n", "{broken"),
    ]
    got = {r.tx_hash: r for r in score.score(spark.createDataFrame(rows, "network string, raw_data string")).collect()}
    assert set(got) == {"dust", "fish", "sat", "plain"}
    assert got["dust"].max_class == "token_dust" and got["dust"].risk_band == "Critical"
    assert got["fish"].max_class == "phishing" and got["fish"].max_score >= 60
    assert got["sat"].max_class == "multiple_sat" and got["sat"].max_score >= 60
    assert got["plain"].max_class is None and got["plain"].risk_band == "Informational"
