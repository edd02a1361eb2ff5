"""Scores of payloads with what a payload alone doesn't settle: what scripts hold, allow-lists, the age of policies; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import score, scorers
from tidemark.plans.registry import settings
from tidemark.queries import _n, query, t

_SCRIPT = "addr_test1w"
#: Of two scripts that spend, the one whose settlements are known to be harmless.
KNOWN_SCRIPT = _SCRIPT + "1".rjust(20, "q")


def spending_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network, raw_data: an order as a transaction that spends each of its lines from one of two scripts. Lines that were returned go
    back to their script with half of their coin, and with all or half of their asset; the others go to a wallet."""
    line = t(spark, sf_dir, "lineitem")
    script = F.concat(F.lit(_SCRIPT), F.lpad((F.col("l_suppkey") % 2).cast("string"), 20, "q"))
    qty = F.col("l_quantity").cast("long")
    value = lambda coin, n: F.map_concat(
        F.create_map(F.lit("ada"), F.create_map(F.lit("lovelace"), coin.cast("long"))), F.create_map(F.lpad((F.col("l_suppkey") % 10).cast("string"), 56, "0"), F.create_map(F.lpad((F.col("l_partkey") % 4).cast("string"), 8, "0"), n))
    )
    back = F.col("l_returnflag") == "R"
    spent = F.struct(F.lit("p").alias("transaction"), F.col("l_linenumber").cast("int").alias("index"), script.alias("address"), value(F.col("l_extendedprice") * 100, qty).alias("value"))
    kept = F.when(F.col("l_linenumber") % 2 == 0, qty).otherwise(F.floor(qty / 2))
    made = F.struct(
        F.when(back, script).otherwise("addr_test1qwallet").alias("address"),
        value(F.when(back, F.col("l_extendedprice") * 50).otherwise(F.col("l_extendedprice") * 100), F.when(back, kept).otherwise(qty)).alias("value"),
    )
    each = line.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.to_json(spent).alias("i"), F.to_json(made).alias("o"), F.col("l_linenumber").cast("string").alias("n"))).alias("x"))
    rows = t(spark, sf_dir, "orders").join(each, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = lambda f: F.array_join(F.transform("x", f), ",")
    cpu = ((F.col("o_orderkey") % 50) * 100_000).cast("string")
    redeemer = lambda x: F.concat(F.lit('{"validator":{"purpose":"spend"},"executionUnits":{"memory":1,"cpu":'), cpu, F.lit('},"redeemer":"'), x["n"], F.lit('"}'))
    raw = F.concat(
        F.lit('{"id":"'), F.col("o_orderkey").cast("string"), F.lit('","fee":1,"inputs":['), joined(lambda x: x["i"]), F.lit('],"outputs":['), joined(lambda x: x["o"]), F.lit('],"redeemers":['), joined(redeemer), F.lit("]}"),
    )
    return rows.select(F.lit("n").alias("network"), raw.alias("raw_data"))


_QTY = "l_quantity::BIGINT"


@query(
    f"""WITH l AS (SELECT l_orderkey AS k, l_suppkey % 2 AS script, l_suppkey % 10 AS pol, l_partkey % 4 AS name, trunc(l_extendedprice * 100)::BIGINT AS coin, {_QTY} AS qty,
CASE WHEN l_returnflag = 'R' THEN trunc(l_extendedprice * 50)::BIGINT ELSE 0 END AS rcoin, CASE WHEN l_returnflag <> 'R' THEN 0 WHEN l_linenumber % 2 = 0 THEN {_QTY} ELSE {_QTY} // 2 END AS rqty
FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT k, script, count(*) FILTER (net > 0) AS gone FROM (SELECT k, script, pol, name, sum(qty) - sum(rqty) AS net FROM l GROUP BY ALL) GROUP BY ALL),
g AS (SELECT k, script, count(*) AS n, sum(coin) AS vin, sum(rcoin) AS vout FROM l GROUP BY ALL),
c AS (SELECT k, count(*) * (k % 50) * 100000 AS cpu FROM l GROUP BY k),
f AS (SELECT k, script = 1 AS known, n, vout, gone, {_n('greatest(vin - vout, 0)::DOUBLE', 5e6, 5e8)} AS s_coin, {_n('gone', 0, 2)} AS s_gone, 1 - {_n('(cpu / (n + 1e-6))', 1e5, 1e7)} AS units, {_n('n', 2, 10)} AS inputs
FROM g JOIN a USING (k, script) JOIN c USING (k) WHERE n >= 2),
s AS (SELECT *, greatest(s_coin, s_gone) AS least_out, round_even(100 * least(0.42 * CASE WHEN known THEN 0 ELSE greatest(s_coin, s_gone) END + 0.28 * units + 0.16 * (1 + CASE WHEN known THEN 0.42 / 0.30 ELSE 0 END) * inputs, 1), 2) AS raw FROM f),
r AS (SELECT *, NOT known AND ((units > 0.8 AND least_out > 0) OR (least_out >= 0.99 AND inputs >= 0.99)) AS lifted FROM s),
e AS (SELECT k, gone, CASE WHEN vout > 0 AND NOT lifted AND least_out < 0.10 THEN -1 WHEN lifted THEN greatest(raw, 60) WHEN vout > 0 THEN least(greatest(raw, 31), 59) ELSE raw END AS score FROM r)
SELECT k::VARCHAR AS tx_hash, max(score)::DOUBLE AS multiple_sat FROM e GROUP BY k"""
)
def script_drains(spark, sf_dir):
    """multiple_sat by coin and assets that leave a script, where one of two scripts is on the allow-list."""
    own = settings({"allow": {"multiple_sat": {"prefixes": {"n": [KNOWN_SCRIPT]}}}}, score.SPECS)
    specs = [s for s in score.SPECS if s.name == "multiple_sat"]
    rows = score.score(spending_payloads(spark, sf_dir), specs, own, every=False)
    return rows.select("tx_hash", F.col("multiple_sat.score").alias("multiple_sat")).filter("multiple_sat IS NOT NULL")


#: Slots after which the test tables' policies count as established: 100 days.
_AGE = 100 * 86_400


def bundle_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network, slot, raw_data: an order as a transaction that puts five tokens for each part and supplier of it at a script, a supplier's
    under one policy. Every fifth order mints under its first policy."""
    parts = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").distinct()
    names = parts.select("*", F.explode(F.array(*[F.lit(str(i)) for i in range(5)])).alias("_i")).withColumn("_n", F.concat(F.lit('"'), F.lpad(F.hex("l_partkey"), 10, "0"), F.col("_i"), F.lit('":1')))
    owned = names.groupBy("l_orderkey", "l_suppkey").agg(F.array_join(F.sort_array(F.collect_list("_n")), ",").alias("_n"))
    policy = F.lpad(F.hex("l_suppkey"), 56, "0")
    held = owned.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('"'), policy, F.lit('":{'), F.col("_n"), F.lit("}")))), ",").alias("_held"), F.min(policy).alias("_first"))
    rows = t(spark, sf_dir, "orders").join(held, F.col("l_orderkey") == F.col("o_orderkey"))
    minted = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(',"mint":{"'), F.col("_first"), F.lit('":{"00":1}}'))).otherwise("")
    raw = F.concat(
        F.lit('{"id":"'), F.col("o_orderkey").cast("string"), F.lit('","fee":1,"inputs":[]'), minted, F.lit(f',"outputs":[{{"address":"{_SCRIPT}held","value":{{"lovelace":'),
        (F.col("o_totalprice") * 100).cast("long").cast("string"), F.lit(","), F.col("_held"), F.lit("}}]}"),
    )
    return rows.select(F.lit("n").alias("network"), _slot().alias("slot"), raw.alias("raw_data"))


def _slot():
    return F.unix_date(F.to_date("o_orderdate")).cast("long") * 86_400


_CENTS = "trunc(o_totalprice * 100)::BIGINT"


@query(
    f"""WITH p AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS pol, l_partkey AS part FROM lineitem),
s AS (SELECT pol, min(o_orderdate::DATE) AS first_day FROM p JOIN orders ON o_orderkey = k GROUP BY pol),
q AS (SELECT k, pol, count(*) * 5 AS names FROM p GROUP BY ALL),
m AS (SELECT k, min(pol) AS least_pol FROM q GROUP BY k),
o AS (SELECT k, any_value(o_totalprice) AS o_totalprice, sum(names) AS tokens, count(*) AS pols, sum(58 + CASE WHEN names < 24 THEN 1 ELSE 2 END + 13 * names) AS owned,
bool_and(o_orderdate::DATE - first_day >= 100 AND NOT (k % 5 = 0 AND pol = least_pol)) AS old FROM q JOIN s USING (pol) JOIN m USING (k) JOIN orders ON o_orderkey = k GROUP BY k),
b AS (SELECT *, 1 + CASE WHEN {_CENTS} < 65536 THEN 3 WHEN {_CENTS} < 4294967296 THEN 5 ELSE 9 END + 1 + owned AS bytes FROM o),
r AS (SELECT *, round_even(100 * (0.35 * {_n('bytes', 100, 1500)} + 0.35 * {_n('tokens', 1, 20)} + 0.15 * (1 - {_n(_CENTS, 1.2e6, 2e6)})), 2) AS raw FROM b)
SELECT k::VARCHAR AS tx_hash, (CASE WHEN NOT (tokens >= 15 OR bytes >= 1000) THEN -1 WHEN tokens < 15 OR old THEN least(raw, 59) ELSE raw END)::DOUBLE AS token_dust FROM r"""
)
def established_bundles(spark, sf_dir):
    """token_dust where collections that are long known get no more than Moderate."""
    orders = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    seen = orders.groupBy(F.lit("n").alias("network"), F.lpad(F.hex("l_suppkey"), 56, "0").alias("policy")).agg(F.min(_slot()).alias("first_slot"))
    specs = [s for s in score.SPECS if s.name == scorers.token_dust.__name__]
    rows = score.score(bundle_payloads(spark, sf_dir), specs, first_seen=seen, age=_AGE, every=False)
    return rows.select("tx_hash", F.col("token_dust.score").alias("token_dust"))
