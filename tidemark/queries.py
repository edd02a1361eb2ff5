"""The ledger operators bound to the tables at hand, each with the SQL that gives the same rows.

``now`` is the latest time in the table. Money is added up as decimals so that sums don't hang on the order of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.functions import text as T
from tidemark.operators import joins, lineage, stats, versions
from tidemark.plans import baselines, cluster, detectors, frozen, score, scorers
from tidemark.sources import store
from tidemark.streaming import poll

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: str | Column) -> Column:
    return F.sum(money(c)).cast("double")


_LINE = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
_ORDER_SCORE = "round(CASE WHEN p99 <= p50 THEN 0 ELSE least(greatest((o_totalprice - p50) / (p99 - p50 + 1e-6), 0), 1) END * 100, 2)"
_BAND = "CASE WHEN {0} >= 80 THEN 'Critical' WHEN {0} >= 60 THEN 'High' WHEN {0} > 30 THEN 'Moderate' ELSE 'Informational' END"
_SCORED = f"""q AS (SELECT list_sort(list(o_totalprice)) AS l FROM orders),
b AS (SELECT l[floor(0.5 * len(l))::BIGINT + 1] AS p50, l[floor(0.99 * len(l))::BIGINT + 1] AS p99 FROM q),
s AS (SELECT orders.*, {_ORDER_SCORE} AS score FROM orders, b)"""


def score_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that scores orders: the price of each between the exact median and 99th percentile of all."""
    orders = t(spark, sf_dir, "orders")
    base = stats.exact_percentiles(orders, [], "o_totalprice", {"p50": 0.5, "p99": 0.99}).drop("n")
    return orders.crossJoin(F.broadcast(base)).withColumn("score", F.round(S.normalise(F.col("o_totalprice"), F.col("p50"), F.col("p99")) * 100, 2)).drop("p50", "p99")


_STORES: dict[tuple[str, str, str], store.Store] = {}


def kept(spark: SparkSession, sf_dir: str, table: str, job: Callable[[store.Store], None]) -> store.Store:
    """The store of a table of ``sf_dir``: the first read of an application has ``job`` write it, and later ones read files only."""
    key = (spark.sparkContext.applicationId, sf_dir, table)
    if key not in _STORES:
        there = store.Store(spark, f"{lineage.shared_folder(spark)}/tidemark-store-{uuid.uuid4().hex}", {"order_scores": store.Stored(None, ("o_orderkey",), None), "raw_payloads": store.Stored("network string, raw_data string", (), None)})
        job(there)
        _STORES[key] = there
    return _STORES[key]


def score_store(spark: SparkSession, sf_dir: str) -> store.Store:
    """Scores of orders, by month."""
    return kept(spark, sf_dir, "order_scores", lambda s: s.put("order_scores", score_orders(spark, sf_dir), 0, F.trunc("o_orderdate", "month")))


def price_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored baselines of line prices, of each supplier and of all."""

    def job(there: store.Store) -> None:
        lines, now = t(spark, sf_dir, "lineitem"), F.current_timestamp()
        every = baselines.measured(lines, "n", "global", ["l_extendedprice"], now)
        there.put("baselines", baselines.measured(lines, "n", "script", ["l_extendedprice"], now, "l_suppkey").unionByName(every), 0)

    return kept(spark, sf_dir, "baselines", job).read("baselines")


def scored_orders(spark: SparkSession, sf_dir: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored scores of orders; of the months from ``since`` to ``until`` alone where they are given."""
    month = lambda d: d and f"{d[:7]}-01"
    return score_store(spark, sf_dir).read("order_scores", month(since), month(until))


def _n(v: str, p50: float, p99: float) -> str:
    return f"least(greatest(({v} - {p50}) / ({p99} - {p50} + 1e-6), 0), 1)"


# --- versions ---------------------------------------------------------------------------------------------------------


@query(
    f"""SELECT l_orderkey, l_linenumber, {', '.join(_LINE)}, l_shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, {' DESC, '.join(_LINE)} DESC) = 1"""
)
def latest_lineitem(spark, sf_dir):
    return versions.latest_by_key(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_shipdate", _LINE)


@query("SELECT l_orderkey, l_linenumber, max(l_shipdate) AS version, arg_max(l_quantity, (l_shipdate, l_partkey, l_suppkey, l_quantity)) AS l_quantity, count(*) AS n_versions FROM lineitem GROUP BY ALL")
def collapse_argmax(spark, sf_dir):
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("version"), F.max_by("l_quantity", order).alias("l_quantity"), F.count(F.lit(1)).alias("n_versions"))


@query("SELECT l_partkey, min(l_shipdate) AS first_slot FROM lineitem GROUP BY ALL")
def policy_first_seen(spark, sf_dir):
    return versions.first_seen(t(spark, sf_dir, "lineitem"), "l_partkey", "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_shipdate > DATE '2000-01-01' AND l_returnflag = 'R')")
def rollback_read(spark, sf_dir):
    """Flags as networks: a rollback to a day takes the later rows of its network."""
    rollback = spark.sql("SELECT 'R' AS network, timestamp_ntz'2000-01-01 00:00:00' AS slot, 1 AS at")
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("network"), "l_shipdate", F.lit(0).alias("written"))
    return versions.without_rolled_back(rows, rollback, "l_shipdate", "written").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_by_key(spark, sf_dir):
    gone = t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return versions.without_keys(t(spark, sf_dir, "lineitem"), gone, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).filter(F.col("ts") >= F.col("now") - F.expr("interval 7 days")).select("event_id", "ts", "user_id")


@query(
    """WITH x AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15'),
old AS (SELECT user_id, event_type AS verdict, ts FROM x WHERE n = 1),
y AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29'),
new AS (SELECT user_id, event_type AS verdict FROM y WHERE n = 1)
SELECT new.user_id, new.verdict FROM new LEFT JOIN old USING (user_id) WHERE new.verdict IS DISTINCT FROM old.verdict
UNION ALL SELECT user_id, 'normal' FROM old WHERE verdict <> 'normal' AND user_id NOT IN (SELECT user_id FROM new)"""
)
def publish_retract(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("verdict"), "ts", "event_id")
    old = versions.latest_by_key(e.filter("ts < timestamp_ntz'2024-01-15 00:00:00'"), ["user_id"], "ts", ["event_id"]).select("user_id", "verdict", F.col("ts").alias("published_at"))
    new = versions.latest_by_key(e.filter("ts >= timestamp_ntz'2024-01-29 00:00:00'"), ["user_id"], "ts", ["event_id"]).select("user_id", "verdict")
    return versions.published(old, new, ["user_id"], "verdict", "normal", F.expr("timestamp_ntz'2024-01-14 00:00:00'")).select("user_id", "verdict")


# --- lists, lookups and joins -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def tx_list_cursor(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").filter("o_orderdate < timestamp_ntz'2000-01-01 00:00:00'")
    return rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def tx_by_address(spark, sf_dir):
    own = t(spark, sf_dir, "customer").filter("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, sf_dir, "orders").join(own, "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_orderkey, o_custkey, o_totalprice, count(l_orderkey) AS n_lines, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 77 GROUP BY ALL")
def tx_detail(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").filter("l_orderkey = 77")
    rows = t(spark, sf_dir, "orders").filter("o_orderkey = 77").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    own = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return rows.groupBy("o_orderkey", "o_custkey", "o_totalprice").agg(F.count("l_orderkey").alias("n_lines"), own.alias("x")).select("o_orderkey", "o_custkey", "o_totalprice", "n_lines", F.col("x.l_linenumber").alias("lines"))


@query(
    f"""WITH {_SCORED} SELECT o_orderkey, score, {_BAND.format('score')} AS risk_band, o_orderpriority FROM s
WHERE score >= 60 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
ORDER BY score DESC, o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10"""
)
def score_list(spark, sf_dir):
    archived = t(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = scored_orders(spark, sf_dir).filter((F.col("score") >= 60) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(archived, "o_custkey", "left_anti")
    return rows.orderBy(F.desc("score"), F.desc("o_orderdate"), "o_orderkey").offset(10).limit(50).select("o_orderkey", "score", S.band(F.col("score")).alias("risk_band"), "o_orderpriority")


@query(f"WITH {_SCORED} SELECT count(*) AS n FROM s WHERE score >= 60 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def score_count(spark, sf_dir):
    archived = t(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return scored_orders(spark, sf_dir).filter("score >= 60").join(archived, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SCORED} SELECT o_orderkey, score FROM s WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey < 20)")
def scores_by_hash(spark, sf_dir):
    some = t(spark, sf_dir, "lineitem").filter("l_partkey < 20").select(F.col("l_orderkey").alias("o_orderkey"))
    return scored_orders(spark, sf_dir).join(some, "o_orderkey", "left_semi").select("o_orderkey", "score")


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F' WHERE l_partkey < 50")
def output_lookup(spark, sf_dir):
    parents = t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    return t(spark, sf_dir, "lineitem").filter("l_partkey < 50").join(parents, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name, o.n AS n_orders, o.n IS NOT NULL AS has_score FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY ALL) o ON o_custkey = c_custkey WHERE c_acctbal < 0")
def archive_list(spark, sf_dir):
    own = t(spark, sf_dir, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return t(spark, sf_dir, "customer").filter("c_acctbal < 0").join(own, "c_custkey", "left").select("c_custkey", "c_name", "n_orders", F.col("n_orders").isNotNull().alias("has_score"))


@query("SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) AS inserted, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)) AS skipped")
def bulk_import_skip(spark, sf_dir):
    """Import of keys into an archive that has some already: one row a key, counts of both kinds."""
    have = t(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    marked = joins.with_marker(t(spark, sf_dir, "orders").select("o_custkey").distinct(), have, ["o_custkey"], "there")
    return marked.agg(F.count_if(~F.col("there")).alias("inserted"), F.count_if("there").alias("skipped"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'F' ELSE 'O' END FROM customer)")
def tuple_membership(spark, sf_dir):
    pairs = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, "F").otherwise("O").alias("o_orderstatus"))
    return t(spark, sf_dir, "orders").join(pairs, ["o_custkey", "o_orderstatus"], "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND (o_orderstatus = 'P' OR o_orderkey IN (SELECT l_orderkey FROM lineitem)) ORDER BY o_orderdate, o_orderkey LIMIT 500")
def unanalyzed_poll(spark, sf_dir):
    """Rows without a score whose inputs are there, or that have none; oldest first."""
    orders, lines = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    rows = orders.join(lines.filter("l_quantity > 45"), "o_orderkey", "left_anti")
    rows = joins.with_marker(rows, lines, ["o_orderkey"], "there").filter((F.col("o_orderstatus") == "P") | F.col("there"))
    return rows.orderBy("o_orderdate", "o_orderkey").limit(500).select("o_orderkey")


@query("SELECT greatest(0, (SELECT count(DISTINCT o_orderkey) FROM orders) - (SELECT count(DISTINCT l_orderkey) FROM lineitem)) AS pending")
def pending_count(spark, sf_dir):
    a, b = t(spark, sf_dir, "orders").agg(F.countDistinct("o_orderkey").alias("a")), t(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey").alias("b"))
    return a.crossJoin(b).select(F.greatest(F.lit(0), F.col("a") - F.col("b")).alias("pending"))


@query(
    """SELECT p.user_id, p.event_id, n.event_id AS nearest FROM (SELECT * FROM events WHERE event_type = 'purchase') p
JOIN LATERAL (SELECT e.event_id FROM events e WHERE e.event_type = 'view' AND e.user_id = p.user_id
ORDER BY abs(epoch_us(e.ts) - epoch_us(p.ts)), e.ts DESC, e.event_id DESC LIMIT 1) n ON true"""
)
def nearest_in_time(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id", "at")
    right = e.filter("event_type = 'view'").select("user_id", F.col("at").alias("at2"), F.col("event_id").alias("id2"))
    return joins.nearest(left, right, ["user_id"], "at", "at2", "id2").select("user_id", "event_id", F.col("nearest.id2").alias("nearest"))


@query(
    """WITH r AS (SELECT DISTINCT o_orderkey AS tx, l_partkey * 100000 + l_suppkey AS ref, epoch(o_orderdate) / 86400 AS at FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT a.tx AS tx_a, b.tx AS tx_b, count(*) AS shared_count, max(b.at - a.at) AS delta FROM r a JOIN r b ON a.ref = b.ref AND a.tx <> b.tx
AND (a.at < b.at OR (a.at = b.at AND a.tx < b.tx)) AND b.at - a.at <= 200 GROUP BY ALL"""
)
def collision_pairs(spark, sf_dir):
    return _collisions(spark, sf_dir)


def _collisions(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_orderkey").alias("tx"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ref"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).alias("at"))
    return joins.shared_reference_pairs(rows, "tx", "ref", "at", 200)


_COLLIDE = "p AS (" + ORACLE_SQL["collision_pairs"].replace("WITH r AS", "WITH r AS") + ")"


@query(
    f"""WITH {_COLLIDE}, o AS (SELECT tx_a, tx_b, delta, a.o_orderstatus AS sa, b.o_orderstatus AS sb, a.o_custkey AS ca, b.o_custkey AS cb
FROM p JOIN orders a ON a.o_orderkey = tx_a JOIN orders b ON b.o_orderkey = tx_b)
SELECT who, count(*) AS wins, count(*) FILTER (delta <= 50) AS wins_soon FROM (SELECT ca AS who, delta FROM o WHERE sa = 'F' AND sb <> 'F' UNION ALL SELECT cb, delta FROM o WHERE sb = 'F' AND sa <> 'F') GROUP BY who"""
)
def collision_wins(spark, sf_dir):
    """Outcome of each collision by the status of both sides, counted for the winner."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    side = lambda s: o.select(F.col("o_orderkey").alias(f"tx_{s}"), F.col("o_orderstatus").alias(f"s{s}"), F.col("o_custkey").alias(f"c{s}"))
    p = _collisions(spark, sf_dir).join(side("a"), "tx_a").join(side("b"), "tx_b")
    won = p.filter("sa = 'F' AND sb <> 'F'").select(F.col("ca").alias("who"), "delta").union(p.filter("sb = 'F' AND sa <> 'F'").select(F.col("cb").alias("who"), "delta"))
    return won.groupBy("who").agg(F.count(F.lit(1)).alias("wins"), F.count_if(F.col("delta") <= 50).alias("wins_soon"))


@query(
    """WITH r AS (SELECT DISTINCT o_orderkey AS tx, o_orderstatus AS st, o_orderdate AS d, l_partkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT c.tx AS confirmed, p.tx AS displaced, count(*) AS refs FROM r c JOIN r p USING (l_partkey, l_suppkey) WHERE c.st = 'F' AND p.st = 'P' AND c.d <> p.d GROUP BY ALL"""
)
def displacement(spark, sf_dir):
    """Pending rows whose references a confirmed row has spent, unless both are of one block."""
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_orderkey").alias("tx"), "o_orderstatus", "o_orderdate", "l_partkey", "l_suppkey").distinct()
    side = lambda status, name, d: rows.filter(F.col("o_orderstatus") == status).select(F.col("tx").alias(name), F.col("o_orderdate").alias(d), "l_partkey", "l_suppkey")
    return side("F", "confirmed", "d1").join(side("P", "displaced", "d2"), ["l_partkey", "l_suppkey"]).filter("d1 <> d2").groupBy("confirmed", "displaced").agg(F.count(F.lit(1)).alias("refs"))


@query(
    """WITH e AS (SELECT event_id, user_id, event_type AS pool, (epoch_us(ts) // 60000000)::BIGINT AS slot FROM events),
m AS (SELECT v.event_id AS victim, l.user_id AS actor, v.slot AS vs, l.slot, l.event_id AS leg FROM e v JOIN e l ON v.pool = l.pool AND abs(v.slot - l.slot) <= 60 AND v.user_id <> l.user_id),
b AS (SELECT victim, actor, max((slot, leg)) FILTER ((slot, leg) < (vs, victim)) AS b, min((slot, leg)) FILTER ((slot, leg) > (vs, victim)) AS a FROM m GROUP BY ALL)
SELECT victim, actor, b[2] AS before, a[2] AS after, (a[1] - b[1])::BIGINT AS span FROM b WHERE a IS NOT NULL AND b IS NOT NULL"""
)
def sandwich_brackets(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("pool"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("slot"))
    return joins.brackets(e, "pool", "user_id", "slot", "event_id", 60)


_EDGES = "e AS (SELECT DISTINCT s_nationkey * 100 + l_partkey % 90 AS u, c_nationkey * 100 + l_suppkey % 90 AS v, (epoch(o_orderdate) / 86400)::BIGINT AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"


def _cycles_sql(hops: int, reach: int) -> str:
    """The hops one after the other: ``f`` is what is reached for the first time, ``b`` what comes back."""
    parts = [
        _EDGES, "e0 AS MATERIALIZED (SELECT * FROM e WHERE u <> v)", "g AS (SELECT u AS o, v AS p, min(s) AS slot FROM e0 GROUP BY ALL)",
        "f1 AS MATERIALIZED (SELECT g.*, min(slot) OVER (PARTITION BY o) AS first FROM g)",
    ]
    for k in range(1, hops + 1):
        parts.append(f"s{k} AS MATERIALIZED (SELECT o, e0.v AS p, min(e0.s) AS slot, first FROM f{k} JOIN e0 ON e0.u = f{k}.p AND e0.s >= slot AND e0.s <= first + {reach} GROUP BY ALL)")
        parts.append(f"b{k} AS MATERIALIZED (SELECT o, slot FROM s{k} WHERE p = o)")
        seen = " UNION ALL ".join(f"SELECT o, p FROM f{j}" for j in range(1, k + 1))
        parts.append(f"f{k + 1} AS MATERIALIZED (SELECT * FROM s{k} WHERE p <> o AND o NOT IN (SELECT o FROM b{k}) AND (o, p) NOT IN ({seen}))")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT o AS origin, {k + 1} AS cycle_length, slot FROM b{k}" for k in range(1, hops + 1))


@query(_cycles_sql(6, 200))
def cycle_hops(spark, sf_dir):
    """Cycles of 2 to 7 edges over all of lineitem."""
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(t(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    edges = rows.select((F.col("s_nationkey") * 100 + F.col("l_partkey") % 90).alias("src"), (F.col("c_nationkey") * 100 + F.col("l_suppkey") % 90).alias("dst"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("long").alias("slot")).distinct()
    return joins.cycles(edges, reach=200)


def _paths_sql(hops: int, reach: int) -> str:
    """As ``_cycles_sql``, but each address reached keeps the least (slot, path)."""
    edge = "{'address': v, 'amount': a, 'slot': s}"
    parts = [
        _EDGES.replace("e AS (SELECT DISTINCT", "e AS (SELECT", 1).replace("AS s FROM", "AS s, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS a FROM", 1)[:-1] + " GROUP BY ALL)",
        "e0 AS MATERIALIZED (SELECT * FROM e WHERE u <> v)", f"g AS (SELECT u AS o, v AS p, min({{'slot': s, 'path': [{edge}]}}) AS m FROM e0 GROUP BY ALL)",
        "f1 AS MATERIALIZED (SELECT o, p, m.slot AS slot, m.path AS path, min(m.slot) OVER (PARTITION BY o) AS first FROM g)",
    ]
    for k in range(1, hops + 1):
        parts.append(f"""m{k} AS MATERIALIZED (SELECT o, v AS p, min({{'slot': s, 'path': list_append(path, {edge})}}) AS m, min(first) AS first
            FROM f{k} JOIN e0 ON e0.u = f{k}.p AND e0.s >= slot AND e0.s <= first + {reach} WHERE slot <= first + {reach} GROUP BY ALL)""")
        parts.append(f"b{k} AS MATERIALIZED (SELECT o, m.path AS path FROM m{k} WHERE p = o)")
        seen = " UNION ALL ".join(f"SELECT o, p FROM f{j}" for j in range(1, k + 1))
        parts.append(f"f{k + 1} AS MATERIALIZED (SELECT o, p, m.slot AS slot, m.path AS path, first FROM m{k} WHERE p <> o AND o NOT IN (SELECT o FROM b{k}) AND (o, p) NOT IN ({seen}))")
    return ",\n".join(parts) + ",\npaths AS (" + " UNION ALL ".join(f"SELECT o, path FROM b{k}" for k in range(1, hops + 1)) + ")"


@query(
    f"""WITH {_paths_sql(5, 120)},
p AS (SELECT o, len(path) AS length, list_transform(path, lambda x: x.amount::DOUBLE) AS am, list_transform(path, lambda x: x.slot) AS sl, list_prepend(o, list_transform(path, lambda x: x.address)) AS who FROM paths),
q AS (SELECT *, list_sum(am) / length AS mean, list_distinct(who) AS kinds, list_max(sl) - list_min(sl) AS span, list_filter(list_transform(range(2, length + 1), lambda i: sl[i] - sl[i - 1]), lambda d: d > 0) AS gaps FROM p),
f AS (SELECT o AS origin, length::INT AS length, round(CASE WHEN mean > 0 THEN greatest(0, least(1, 1 - sqrt(list_sum(list_transform(am, lambda x: (x - mean) * (x - mean))) / (length - 1)) / mean)) ELSE 0 END, 4) AS sim,
round(CASE WHEN am[1] > 0 THEN greatest(am[1] - am[-1], 0) / am[1] ELSE 1 END, 4) AS loss,
round(-list_sum(list_transform(kinds, lambda k: len(list_filter(who, lambda x: x = k)) / len(who) * log2(len(list_filter(who, lambda x: x = k)) / len(who)))) / log2(len(kinds)), 4) AS ent,
am[1] > 0 AND am[1] % 1000000 = 0 AS flag, round(CASE WHEN span > 0 THEN least(1, length / span) ELSE 1 END, 4) AS tmp, round(CASE WHEN len(gaps) > 0 THEN list_sum(gaps) / len(gaps) ELSE 100 END, 2) AS hop FROM q),
x AS (SELECT *, {_n('sim', 0.7, 0.97)} AS a, {_n('(1 - ent)', 0.2, 0.7)} AS e, (flag::INT + {_n('tmp', 0.3, 0.85)}) / 2 AS x, {_n('(1 / hop)', 0.05, 0.5)} AS v FROM f),
s AS (SELECT *, e + x + v < 0.1 AS bare, round_even(100 * least(greatest(0.3 * a + 0.2 * e + 0.1 * x + 0.1 * v, 0), 1), 2) AS raw FROM x)
SELECT origin, length, sim AS similarity, loss AS net_loss, ent AS entropy, flag AS round_amount, tmp AS temporal, hop AS hop_slots,
CASE WHEN length BETWEEN 3 AND 6 AND loss <= length * 0.02 * 4 AND NOT bare THEN CASE WHEN loss > 2 * 0.02 THEN least(raw, 59) ELSE raw END ELSE -1 END AS score FROM s"""
)
def cycle_scores(spark, sf_dir):
    """Cycles of 2 to 6 edges over all of lineitem, with the path of each, scored."""
    rows = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(t(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    edges = rows.groupBy((F.col("s_nationkey") * 100 + F.col("l_partkey") % 90).alias("src"), (F.col("c_nationkey") * 100 + F.col("l_suppkey") % 90).alias("dst"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("long").alias("slot"))
    edges = edges.agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("amount"))
    return detectors.circular_scores(edges, hops=5, reach=120).withColumn("score", F.col("circular.score")).drop("circular", "recurrence")


@query(
    f"""WITH e AS (SELECT event_id, user_id, event_type AS pool, (epoch_us(ts) // 60000000)::BIGINT AS slot, value::DECIMAL(28,6) AS rate, (event_id % 5 - 2) * round(value * 10000)::BIGINT AS net FROM events),
r AS (SELECT *, sum(rate) OVER w::DOUBLE / nullif(count(rate) OVER w, 0) AS base FROM e WINDOW w AS (PARTITION BY pool ORDER BY slot RANGE BETWEEN 600 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, abs(rate::DOUBLE - base) / nullif(base, 0) AS off FROM r),
m AS (SELECT v.event_id AS victim, l.user_id AS actor, v.slot AS vs, l.slot, l.event_id AS leg FROM e v JOIN e l ON v.pool = l.pool AND abs(v.slot - l.slot) <= 60 AND v.user_id <> l.user_id WHERE l.user_id % 10 <> 0),
b AS (SELECT victim, actor, vs, max((slot, leg)) FILTER ((slot, leg) < (vs, victim)) AS b, min((slot, leg)) FILTER ((slot, leg) > (vs, victim)) AS a FROM m GROUP BY ALL),
g AS (SELECT victim, actor, vs, b[2] AS before, a[2] AS after, (a[1] - b[1])::BIGINT AS span, x.net + y.net AS profit, x.off AS impact FROM b JOIN k x ON x.event_id = b[2] JOIN k y ON y.event_id = a[2] WHERE a IS NOT NULL AND b IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY victim ORDER BY profit DESC, actor) = 1),
h AS (SELECT victim, (SELECT count(*) FROM e WHERE e.user_id = g.actor AND e.slot < g.vs) AS n FROM g),
f AS (SELECT g.*, n, coalesce(v.off, 0) AS rate, coalesce(g.impact, 0) AS imp FROM g JOIN h USING (victim) JOIN k v ON v.event_id = g.victim)
SELECT victim, actor, before, after, span, profit::BIGINT AS profit, n AS count,
CASE WHEN span <= 5 AND profit >= 200000 THEN round_even(100 * least(greatest(0.30 + 0.30 * {_n('rate', 0, 0.15)} + 0.20 * {_n('imp', 0, 0.05)} + 0.10 * {_n('profit', 0, 5e6)} + 0.10 * {_n('n', 0, 5)}, 0), 1), 2) ELSE -1 END AS score FROM f"""
)
def sandwich_economics(spark, sf_dir):
    """Each victim's most profitable bracket, scored; every tenth user stands for a script."""
    e = t(spark, sf_dir, "events")
    slot, net = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60), (F.col("event_id") % 5 - 2) * F.round(F.col("value") * 10_000).cast("long")
    legs = e.select(F.col("event_id").alias("tx"), F.col("event_type").alias("pool"), F.col("user_id").alias("actor"), slot.alias("at"), net.alias("net"), F.col("value").cast("decimal(28,6)").cast("double").alias("rate"), (F.col("user_id") % 10 == 0).alias("is_script"))
    return detectors.sandwich_scores(legs, 60, 600).withColumn("score", F.col("sandwich.score")).drop("sandwich", "rate_delta", "price_impact")


@query("SELECT o_custkey AS address, o_orderkey AS tx FROM orders UNION SELECT l_suppkey + 1000000, l_orderkey FROM lineitem")
def address_index(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    both = F.filter(F.array("o_custkey", F.col("l_suppkey") + 1000000), lambda x: x.isNotNull())
    return rows.select(F.explode(both).alias("address"), F.col("o_orderkey").alias("tx")).distinct()


# --- aggregates -------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS mean, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def tx_stats_summary(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01 00:00:00' AND o_orderdate < timestamp_ntz'1999-01-01 00:00:00'")
    return rows.agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("total"), (total("o_totalprice") / F.count(F.lit(1))).alias("mean"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("SELECT o_orderdate AS height, o_orderpriority AS hash, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY ALL ORDER BY height DESC, hash DESC LIMIT 20")
def recent_blocks(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").filter("o_orderdate IS NOT NULL").groupBy(F.col("o_orderdate").alias("height"), F.col("o_orderpriority").alias("hash"))
    return rows.agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("total")).orderBy(F.desc("height"), F.desc("hash")).limit(20)


@query("SELECT count(*) AS n, count(*) / 600.0::DOUBLE AS per_minute FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 600 MINUTE")
def throughput(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    rows = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).filter(F.col("ts") > F.col("now") - F.expr("interval 600 minutes"))
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / 600.0).alias("per_minute"))


@query(
    f"""WITH {_SCORED} SELECT o_orderpriority, count(*) AS n, count(*) FILTER (score >= 80) AS critical, count(*) FILTER (score >= 60 AND score < 80) AS high, count(*) FILTER (score > 30 AND score < 60) AS moderate,
max(score) FILTER (score > 0) AS top, sum((score)::DECIMAL(18,2)) FILTER (score > 0)::DOUBLE / count(*) FILTER (score > 0) AS mean FROM s GROUP BY ALL"""
)
def class_stats(spark, sf_dir):
    s = F.col("score")
    engaged = F.when(s > 0, s)
    return scored_orders(spark, sf_dir).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s >= 80).alias("critical"), F.count_if((s >= 60) & (s < 80)).alias("high"), F.count_if((s > 30) & (s < 60)).alias("moderate"),
        F.max(engaged).alias("top"), (total(engaged) / F.count_if(s > 0)).alias("mean"),
    )


@query(
    """WITH d AS (SELECT unnest(generate_series((SELECT max(ts)::DATE FROM events) - INTERVAL 40 DAY, (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day)
SELECT day, count(DISTINCT user_id) AS n FROM d LEFT JOIN (SELECT * FROM events WHERE event_type = 'error' AND value > 40) e ON e.ts::DATE = day GROUP BY day"""
)
def alert_timeseries(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    last = e.agg(F.to_date(F.max("ts")).alias("d")).first().d
    return stats.daily_counts(e.filter("event_type = 'error' AND value > 40"), "ts", F.date_sub(F.lit(last), 40), F.lit(last), F.col("user_id"))


@query(f"WITH {_SCORED}, b2 AS (SELECT *, {_BAND.format('score')} AS band FROM s) SELECT 'band' AS kind, band AS name, count(*) AS n FROM b2 GROUP BY ALL UNION ALL SELECT 'class', o_orderpriority, count(*) FROM b2 WHERE band IN ('High', 'Critical') GROUP BY ALL")
def window_counts(spark, sf_dir):
    rows = scored_orders(spark, sf_dir).withColumn("band", S.band(F.col("score")))
    by = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return by(rows, "band", "band").unionByName(by(rows.filter(F.col("band").isin(*S.ALERT_BANDS)), "class", "o_orderpriority"))


@query("WITH q AS (SELECT list_sort(list(l_extendedprice)) AS l FROM lineitem) SELECT l[floor(0.5 * len(l))::BIGINT + 1] AS p50, l[floor(0.99 * len(l))::BIGINT + 1] AS p99, len(l)::BIGINT AS n FROM q")
def exact_percentiles(spark, sf_dir):
    return stats.exact_percentiles(t(spark, sf_dir, "lineitem"), [], "l_extendedprice", {"p50": 0.5, "p99": 0.99})


_BY_SUPPLIER = "q AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS l FROM lineitem GROUP BY ALL), sc AS (SELECT l_suppkey, l[floor(0.5 * len(l))::BIGINT + 1] AS p50, l[floor(0.99 * len(l))::BIGINT + 1] AS p99, len(l)::BIGINT AS n FROM q)"


@query(f"WITH {_BY_SUPPLIER} SELECT * FROM sc")
def scoped_percentiles(spark, sf_dir):
    return stats.exact_percentiles(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", {"p50": 0.5, "p99": 0.99})


@query("WITH q AS (SELECT user_id, list_sort(list(json_extract_string(props, '$.k')::BIGINT)) AS l FROM events GROUP BY ALL) SELECT user_id, l[floor(0.5 * len(l))::BIGINT + 1] AS p50, l[floor(0.9 * len(l))::BIGINT + 1] AS p90, len(l)::BIGINT AS n FROM q WHERE len(l) >= 60")
def evidence_percentiles(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return stats.exact_percentiles(rows, ["user_id"], "k", {"p50": 0.5, "p90": 0.9}).filter("n >= 60")


@query("SELECT l_suppkey AS address, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) >= 20 ORDER BY n DESC, address LIMIT 100")
def active_scripts(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("address")).agg(F.count(F.lit(1)).alias("n"))
    return rows.filter("n >= 20").orderBy(F.desc("n"), "address").limit(100)


@query(
    f"""WITH {_BY_SUPPLIER}, g AS (SELECT list_sort(list(l_extendedprice)) AS l FROM lineitem), gl AS (SELECT l[floor(0.5 * len(l))::BIGINT + 1] AS p50, l[floor(0.99 * len(l))::BIGINT + 1] AS p99 FROM g)
SELECT s_suppkey, CASE WHEN ok THEN 'scope' ELSE 'global' END AS tier, CASE WHEN ok THEN sc.p50 ELSE gl.p50 END AS p50, CASE WHEN ok THEN sc.p99 ELSE gl.p99 END AS p99
FROM (SELECT s_suppkey, sc.*, coalesce(n >= 200 AND CASE WHEN sc.p50 <= 0 THEN sc.p99 > 0 ELSE (sc.p99 - sc.p50) / sc.p50 >= 0.1 END, false) AS ok FROM supplier LEFT JOIN sc ON l_suppkey = s_suppkey) sc, gl"""
)
def baseline_resolve(spark, sf_dir):
    """A scope's own baseline where it has samples enough and spreads, else the global one."""
    stored = price_baselines(spark, sf_dir)
    own = stored.filter("scope_type = 'script'").select(F.col("scope_id").cast("long").alias("s_suppkey"), F.col("p50").alias("a"), F.col("p99").alias("b"), F.col("sample_count").alias("n"))
    every = stored.filter("scope_type = 'global'").select(F.col("p50").alias("g50"), F.col("p99").alias("g99"))
    rows = t(spark, sf_dir, "supplier").select("s_suppkey").join(own, "s_suppkey", "left").crossJoin(F.broadcast(every))
    ok = F.coalesce((F.col("n") >= 200) & S.usable(F.col("a"), F.col("b")), F.lit(False))
    return rows.select("s_suppkey", F.when(ok, "scope").otherwise("global").alias("tier"), F.when(ok, F.col("a")).otherwise(F.col("g50")).alias("p50"), F.when(ok, F.col("b")).otherwise(F.col("g99")).alias("p99"))


@query(f"WITH {_BY_SUPPLIER} SELECT l_suppkey, least(p50, least(20000 + 0.25 * 40000, least(p99, 5 * 60000.0) / 1.1)) AS p50, least(p99, 5 * 60000.0) AS p99 FROM sc")
def baseline_capped(spark, sf_dir):
    own = price_baselines(spark, sf_dir).filter("scope_type = 'script'").withColumn("l_suppkey", F.col("scope_id").cast("long"))
    low, top = S.capped(F.col("p50"), F.col("p99"), F.lit(20000.0), F.lit(60000.0))
    return own.select("l_suppkey", low.alias("p50"), top.alias("p99"))


_HALF = "{0} AS (SELECT user_id, list_sort(list(value)) AS l FROM events WHERE ts {1} TIMESTAMP '2024-01-15' GROUP BY ALL)"


@query(
    f"""WITH {_HALF.format('a', '<')}, {_HALF.format('b', '>=')}, x AS (SELECT user_id, a.l[floor(0.5 * len(a.l))::BIGINT + 1] AS o50, a.l[floor(0.99 * len(a.l))::BIGINT + 1] AS o99,
b.l[floor(0.5 * len(b.l))::BIGINT + 1] AS n50, b.l[floor(0.99 * len(b.l))::BIGINT + 1] AS n99 FROM b LEFT JOIN a USING (user_id))
SELECT user_id, coalesce((abs(n99 - o99) / (abs(o99) + 1e-9) > 0.5 AND o99 > 0 AND n99 > o99) OR (abs(n50 - o50) / (abs(o50) + 1e-9) > 0.5 AND n50 > o50), false) AS held FROM x"""
)
def drift_hold(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    half = lambda cond, a, b: stats.exact_percentiles(e.filter(cond), ["user_id"], "value", {a: 0.5, b: 0.99}).drop("n")
    rows = half("ts >= timestamp_ntz'2024-01-15 00:00:00'", "n50", "n99").join(half("ts < timestamp_ntz'2024-01-15 00:00:00'", "o50", "o99"), "user_id", "left")
    return rows.select("user_id", F.coalesce(S.held(F.col("o50"), F.col("n50"), F.col("o99"), F.col("n99")), F.lit(False)).alias("held"))


@query(
    f"""WITH {_HALF.format('a', '<')}, {_HALF.format('b', '>=')}, x AS (SELECT user_id, a.l[floor(0.5 * len(a.l))::BIGINT + 1] AS o50, a.l[floor(0.99 * len(a.l))::BIGINT + 1] AS o99,
b.l[floor(0.5 * len(b.l))::BIGINT + 1] AS n50, b.l[floor(0.99 * len(b.l))::BIGINT + 1] AS n99 FROM b JOIN a USING (user_id)),
y AS (SELECT user_id, unnest([{{'axis': 'p50', 'o': o50, 'n': n50}}, {{'axis': 'p99', 'o': o99, 'n': n99}}]) AS e, o50, n50, o99, n99 FROM x),
z AS (SELECT *, CASE WHEN e.o = 0 THEN e.n > 0 ELSE abs(e.n - e.o) / (abs(e.o) + 1e-9) > 0.5 END AS drifted,
CASE WHEN o50 = 0 THEN n50 > 0 ELSE abs(n50 - o50) / (abs(o50) + 1e-9) > 0.5 END AND n50 > o50 AS h50, CASE WHEN o99 = 0 THEN n99 > 0 ELSE abs(n99 - o99) / (abs(o99) + 1e-9) > 0.5 END AND n99 > o99 AND o99 > 0 AS h99 FROM y)
SELECT user_id::VARCHAR AS scope_id, e.axis AS axis, e.o AS old_value, e.n AS new_value, NOT (h50 OR h99) AS applied FROM z WHERE drifted"""
)
def drift_events(spark, sf_dir):
    """What is logged as each user's values of the second half of a month are held against the stored ones of the first."""

    def job(there: store.Store) -> None:
        e = t(spark, sf_dir, "events")
        for k, half in enumerate(("<", ">=")):
            fresh = baselines.measured(e.filter(f"ts {half} timestamp_ntz'2024-01-15 00:00:00'"), "n", "user", ["value"], F.current_timestamp(), "user_id")
            baselines.recompute(there, fresh, k)

    return kept(spark, sf_dir, "baseline_drift_events", job).read("baseline_drift_events").select("scope_id", "axis", "old_value", "new_value", "applied")


@query(
    """WITH s AS (SELECT o_orderkey, round_even(100 * least(greatest((o_totalprice - 50000) / (400000.0 - 50000 + 1e-6), 0), 1), 2) AS score FROM orders)
SELECT o_orderkey::VARCHAR AS tx_hash, score AS large_value, -1.0 AS phishing, score AS max_score FROM s"""
)
def polled_scores(spark, sf_dir):
    """Scores as polls write them, in three batches."""
    orders = t(spark, sf_dir, "orders")
    txs = orders.select(F.lit("n").alias("network"), F.col("o_orderkey").cast("string").alias("tx_hash"), F.col("o_orderdate").cast("timestamp").alias("ingestion_timestamp"), F.trunc("o_orderdate", "year").alias("timestamp"), "o_totalprice")

    def analyse(rows: DataFrame) -> DataFrame:
        value = S.finalise(S.normalise(F.col("o_totalprice"), 50_000, 400_000))
        return rows.select("network", "tx_hash", value.alias("large_value"), value.alias("max_score"))

    def job(there: store.Store) -> None:
        each = orders.count() // 3 + 1
        # all rows are looked at each time, as the orders' dates aren't those of their arrival
        poll.Poll(there, "n", lambda: txs, analyse, batch=each, rescan=0).drain(3)

    return kept(spark, sf_dir, "tx_class_scores", job).read("tx_class_scores").select("tx_hash", "large_value", "phishing", "max_score")


@query("SELECT p_partkey, CASE WHEN p_size >= 1 THEN least(greatest((p_retailprice - 950) / (1800.0 - 950 + 1e-6), 0), 1) END AS n, 1 - least(greatest((p_retailprice - 950) / (1800.0 - 950 + 1e-6), 0), 1) AS inverted, 0.0::DOUBLE AS flat FROM part")
def normalise(spark, sf_dir):
    v = F.col("p_retailprice")
    return t(spark, sf_dir, "part").select("p_partkey", S.normalise(v, 950, 1800).alias("n"), S.normalise_inverted(v, 950, 1800).alias("inverted"), S.normalise_inverted(v, 5, 5).alias("flat"))


@query(f"SELECT c_custkey, {_BAND.format('(c_acctbal / 100)')} AS risk_band FROM customer")
def risk_band(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", S.band(F.col("c_acctbal") / 100).alias("risk_band"))


_AXES = "x AS (SELECT p_partkey, (p_size * 2)::DOUBLE AS size, (p_retailprice / 20)::DOUBLE AS price, CASE WHEN p_brand LIKE '%2' THEN 55.0 ELSE -1.0 END AS brand FROM part)"


@query(
    f"""WITH {_AXES}, y AS (SELECT *, greatest(size, price, brand) AS top FROM x) SELECT p_partkey, top AS max_score, CASE WHEN size = top THEN 'size' WHEN price = top THEN 'price' ELSE 'brand' END AS max_class,
((size >= 40)::INT + (price >= 40)::INT + (brand >= 40)::INT) AS corroboration_count, array_to_string(list_filter([CASE WHEN brand >= 40 THEN 'brand' END, CASE WHEN price >= 40 THEN 'price' END, CASE WHEN size >= 40 THEN 'size' END], lambda z: z IS NOT NULL), ',') AS classes FROM y"""
)
def argmax_class(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    axes = [("size", (F.col("p_size") * 2).cast("double")), ("price", F.col("p_retailprice") / 20), ("brand", F.when(F.col("p_brand").endswith("2"), 55.0).otherwise(-1.0))]
    top, name = S.first_max(axes)
    n, names = S.corroborating(axes)
    return p.select("p_partkey", top.alias("max_score"), name.alias("max_class"), n.alias("corroboration_count"), names.alias("classes"))


@query(
    """WITH l AS (SELECT user_id, min(ts) FILTER (event_type = 'view') AS seen, min(ts) FILTER (event_type = 'purchase') AS confirmed, max(ts) FILTER (event_type = 'error') AS lost FROM events GROUP BY ALL),
s AS (SELECT *, CASE WHEN lost > confirmed THEN 'ROLLED_BACK' WHEN confirmed IS NOT NULL THEN 'CONFIRMED' ELSE 'PENDING' END AS status FROM l)
SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'ROLLED_BACK') AS rolled_back,
round(100.0 * count(*) FILTER (status = 'ROLLED_BACK') / count(*), 4) AS rollback_rate FROM s"""
)
def lifecycle_summary(spark, sf_dir):
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("ts"))
    rows = t(spark, sf_dir, "events").groupBy("user_id").agg(F.min(at("view")).alias("seen"), F.min(at("purchase")).alias("confirmed"), F.max(at("error")).alias("lost"))
    status = F.when(F.col("lost") > F.col("confirmed"), "ROLLED_BACK").when(F.col("confirmed").isNotNull(), "CONFIRMED").otherwise("PENDING")
    n = {s: F.count_if(F.col("status") == s) for s in ("PENDING", "CONFIRMED", "ROLLED_BACK")}
    return rows.withColumn("status", status).agg(n["PENDING"].alias("pending"), n["CONFIRMED"].alias("confirmed"), n["ROLLED_BACK"].alias("rolled_back"), F.round(100.0 * n["ROLLED_BACK"] / F.count(F.lit(1)), 4).alias("rollback_rate"))


@query("SELECT user_id, (epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'view'))) / 1000 AS latency_ms FROM events GROUP BY ALL")
def lifecycle_latency(spark, sf_dir):
    at = lambda kind: F.unix_micros(F.min(F.when(F.col("event_type") == kind, F.col("ts"))).cast("timestamp"))
    return t(spark, sf_dir, "events").groupBy("user_id").agg(((at("purchase") - at("view")) / 1000).alias("latency_ms"))


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY ALL HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 7200 SECOND")
def dropped_sweep(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).filter(F.col("last") < F.col("now") - F.expr("interval 7200 seconds")).select("user_id", "last")


@query("SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END::DECIMAL(18,2))::DOUBLE AS net FROM lineitem GROUP BY ALL")
def asset_net_flow(spark, sf_dir):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(total(signed).alias("net"))


@query("SELECT count(*) AS positive FROM (SELECT l_suppkey, l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END::DECIMAL(18,2)) AS net FROM lineitem GROUP BY ALL) WHERE net > 0")
def positive_assets(spark, sf_dir):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(money(signed)).alias("net")).agg(F.count_if(F.col("net") > 0).alias("positive"))


@query("SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_linestatus = 'O')::DOUBLE AS flow_in, sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_linestatus = 'F')::DOUBLE AS flow_out FROM lineitem GROUP BY ALL")
def attacker_net(spark, sf_dir):
    at = lambda s: total(F.when(F.col("l_linestatus") == s, F.col("l_extendedprice")))
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(at("O").alias("flow_in"), at("F").alias("flow_out"))


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS n_assets, count(DISTINCT l_suppkey) AS n_policies FROM lineitem GROUP BY ALL")
def distinct_assets(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("n_assets"), F.countDistinct("l_suppkey").alias("n_policies"))


@query("SELECT user_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY user_id")
def entropy(spark, sf_dir):
    return stats.entropy(t(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", F.round("entropy", 6).alias("entropy"))


@query("SELECT l_suppkey, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY ALL")
def variation(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.stddev_samp("l_quantity") / F.avg("l_quantity"), 6).alias("cv"))


# --- windows ----------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def recent_per_target(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT p_partkey, (rank() OVER (ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_size) - 1) / 2) / (count(*) OVER () - 1) AS r FROM part")
def rank_norm(spark, sf_dir):
    return stats.rank_percentile(t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "r").select("p_partkey", "r")


@query("SELECT event_id, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY epoch_us(lead(ts) OVER w) - epoch_us(ts) > 0")
def hop_deltas(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", (F.lead("us").over(W.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("us")).alias("delta")).filter("delta > 0")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)")
def sliding_limiter(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count(F.lit(1)).over(W.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0)).alias("in_window"))


# --- features, clusters and verdicts ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, sign(o_totalprice) * ln(1 + abs(o_totalprice)) AS log_price, hour(o_orderdate)::INT AS h, isodow(o_orderdate)::INT AS dow, round(sin(2 * pi() * ((isodow(o_orderdate) - 1) % 7) / 7), 9) AS dow_sin, round(cos(2 * pi() * ((isodow(o_orderdate) - 1) % 7) / 7), 9) AS dow_cos FROM orders")
def shape_features(spark, sf_dir):
    dow = F.weekday("o_orderdate") + 1
    sin, cos = S.cyclical((dow - 1) % 7, 7)
    return t(spark, sf_dir, "orders").select("o_orderkey", S.signed_log(F.col("o_totalprice")).alias("log_price"), F.hour("o_orderdate").alias("h"), dow.alias("dow"), F.round(sin, 9).alias("dow_sin"), F.round(cos, 9).alias("dow_cos"))


@query(
    """WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) AS b FROM customer)
SELECT c_custkey, round((c_acctbal - m) / CASE WHEN b = a THEN 1 ELSE b - a END, 9) AS scaled FROM customer, q"""
)
def robust_scale(spark, sf_dir):
    return stats.robust_scale(t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 9).alias("scaled"))


@query(
    """WITH s AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS i FROM lineitem), n AS (SELECT r, count(*) AS n FROM s GROUP BY r)
SELECT x.a, x.b, x.common, x.common / (p.n + q.n - x.common) AS similarity FROM (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b USING (i) WHERE a.r < b.r GROUP BY ALL) x
JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE x.common / (p.n + q.n - x.common) >= 0.2"""
)
def jaccard_pairs(spark, sf_dir):
    return joins.jaccard_pairs(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 0.2)


@query(
    """WITH s AS (SELECT DISTINCT o_custkey AS r, l_partkey AS i FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
SELECT a.r AS a, b.r AS b, count(*) AS weight FROM s a JOIN s b USING (i) WHERE a.r < b.r GROUP BY ALL ORDER BY weight DESC, a, b LIMIT 2000"""
)
def graph_edges(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").join(t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = joins.jaccard_pairs(rows, "o_custkey", "l_partkey", 0.0)
    return pairs.select("a", "b", F.col("common").alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(2000)


@query("SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 5) AS mean FROM embeddings GROUP BY ALL")
def cluster_summary(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get("embedding", F.lit(0)).cast("double")), 5).alias("mean"))


@query("SELECT avg((label = 0)::INT) AS noise_rate FROM (SELECT label FROM embeddings ORDER BY vec_id DESC LIMIT 200)")
def noise_rate(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").orderBy(F.desc("vec_id")).limit(200).agg(F.avg((F.col("label") == 0).cast("int")).alias("noise_rate"))


@query(
    """WITH c AS (SELECT label, i, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL),
v AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
d AS (SELECT vec_id, c.label, sqrt(sum((v.v::DOUBLE - c.m) ** 2)) AS dist FROM v JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, label AS cluster, round(dist, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) = 1"""
)
def nearest_centroid(spark, sf_dir):
    """A model of means of all rows, broadcast; every row goes to the nearest."""
    e = t(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    model = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean")).agg(F.collect_list(F.struct("label", "mean")).alias("model"))
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with("embedding", c["mean"], lambda a, b: F.pow(a.cast("double") - b, F.lit(2))), F.lit(0.0), lambda s, x: s + x))
    best = F.array_min(F.transform("model", lambda c: F.struct(gap(c).alias("d"), c["label"].alias("label"))))
    return e.crossJoin(F.broadcast(model)).select("vec_id", best.alias("b")).select("vec_id", F.col("b.label").alias("cluster"), F.round("b.d", 6).alias("distance"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 'malicious' WHEN c_mktsegment = 'BUILDING' AND c_nationkey <> 0 THEN 'benign' WHEN ((c_acctbal > 9000)::INT + (c_nationkey > 20)::INT) >= 2 THEN 'anomaly' ELSE 'normal' END AS verdict FROM customer"""
)
def verdict_resolve(spark, sf_dir):
    """An explicit label, else one inherited from a labelled cluster (never from noise), else two votes, else normal."""
    c = t(spark, sf_dir, "customer")
    explicit = F.when(F.col("c_acctbal") < -500, "malicious")
    labels = spark.createDataFrame([("BUILDING", "benign")], "c_mktsegment string, label string")
    votes = (F.col("c_acctbal") > 9000).cast("int") + (F.col("c_nationkey") > 20).cast("int")
    return c.join(F.broadcast(labels), "c_mktsegment", "left").select("c_custkey", cluster.verdict(explicit, F.col("label"), F.when(F.col("c_nationkey") == 0, -1).otherwise(F.col("c_nationkey")), votes).alias("verdict"))


@query(
    """WITH z AS (SELECT p_partkey, [{'m': abs(p_size - 25) / 12.0, 'f': 'size'}, {'m': abs(p_retailprice - 1400) / 250.0, 'f': 'price'}, {'m': p_partkey % 7 / 2.0, 'f': 'key'}] AS r FROM part)
SELECT p_partkey, coalesce(nullif(array_to_string(list_transform(list_reverse_sort(list_filter(r, lambda x: x.m >= 1.5))[1:2], lambda x: x.f), ','), ''), 'combination') AS reasons FROM z"""
)
def explain_reasons(spark, sf_dir):
    """The strongest features above a threshold by magnitude; where none is, it is their combination."""
    parts = [("size", F.abs(F.col("p_size") - 25) / 12.0), ("price", F.abs(F.col("p_retailprice") - 1400) / 250.0), ("key", F.col("p_partkey") % 7 / 2.0)]
    reasons = F.sort_array(F.filter(F.array(*[F.struct(m.alias("m"), F.lit(f).alias("f")) for f, m in parts]), lambda x: x["m"] >= 1.5), asc=False)
    names = F.array_join(F.transform(F.slice(reasons, 1, 2), lambda x: x["f"]), ",")
    return t(spark, sf_dir, "part").select("p_partkey", F.when(names == "", "combination").otherwise(names).alias("reasons"))


@query(
    f"""WITH {_SCORED}, v AS (SELECT o_orderkey, max(CASE WHEN l_quantity > 49 THEN greatest(80.0, 70) WHEN l_quantity > 40 THEN l_discount * 10 * 59 ELSE 0 END) AS ca FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey, round(greatest(score, coalesce(ca, 0)), 4) AS effective, CASE WHEN coalesce(ca, 0) > score THEN 'contract_anomaly' ELSE o_orderpriority END AS max_class FROM s LEFT JOIN v USING (o_orderkey)"""
)
def overlay_merge(spark, sf_dir):
    """Clustering verdicts over stored scores: they only raise, and take the class only where strictly larger."""
    verdict = F.when(F.col("l_quantity") > 49, "malicious").when(F.col("l_quantity") > 40, "anomaly").otherwise("normal")
    consensus = F.when(F.col("l_quantity") > 49, 0.7).otherwise(F.col("l_discount") * 10)
    own = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(S.verdict_score(verdict, consensus)).alias("ca"))
    ca = F.coalesce("ca", F.lit(0.0))
    rows = scored_orders(spark, sf_dir).join(own, "o_orderkey", "left")
    return rows.select("o_orderkey", F.round(F.greatest("score", ca), 4).alias("effective"), F.when(ca > F.col("score"), "contract_anomaly").otherwise(F.col("o_orderpriority")).alias("max_class"))


@query(
    f"""WITH {_SCORED}, b2 AS (SELECT o_orderkey, o_orderpriority, {_BAND.format('score')} AS band FROM s), r(i, band, cls, action) AS (VALUES (1, 'Critical', NULL, 'page'), (2, 'High', NULL, 'mail'), (3, 'Critical', '5-LOW', 'mute'))
SELECT o_orderkey, arg_max(action, i) AS action FROM b2 JOIN r ON r.band = b2.band AND (r.cls IS NULL OR r.cls = o_orderpriority) GROUP BY o_orderkey"""
)
def route_rules(spark, sf_dir):
    rules = spark.createDataFrame([(1, "Critical", None, "page"), (2, "High", None, "mail"), (3, "Critical", "5-LOW", "mute")], "rule_index int, r_band string, r_class string, action string")
    rows = scored_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", S.band(F.col("score")).alias("band"))
    match = (F.col("r_band") == F.col("band")) & (F.col("r_class").isNull() | (F.col("r_class") == F.col("o_orderpriority")))
    return joins.last_matching_rule(rows, rules, match, "o_orderkey").filter("action IS NOT NULL")


@query(
    """WITH x AS (SELECT event_id, user_id, ts, CASE WHEN value >= 80 THEN 3 WHEN value >= 60 THEN 2 WHEN value > 30 THEN 1 ELSE 0 END AS rank FROM events),
y AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS was FROM x)
SELECT event_id, user_id, rank FROM y WHERE rank > was AND rank >= 1"""
)
def notify_escalation(spark, sf_dir):
    """One notification for each key and rise of its band."""
    v = F.col("value")
    rows = t(spark, sf_dir, "events").withColumn("rank", F.when(v >= 80, 3).when(v >= 60, 2).when(v > 30, 1).otherwise(0))
    was = F.coalesce(F.max("rank").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    return rows.withColumn("was", was).filter("rank > was AND rank >= 1").select("event_id", "user_id", "rank")


@query("SELECT o_orderkey, o_totalprice, 'host' AS arm FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' UNION ALL SELECT o_orderkey, o_totalprice, 'local' FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')")
def hybrid_union(spark, sf_dir):
    """The host's rows, and local ones whose key the host has not."""
    o = t(spark, sf_dir, "orders")
    host = o.filter("o_orderdate < timestamp_ntz'1998-01-01 00:00:00'")
    local = versions.new_rows(o, host, ["o_orderkey"])
    return host.select("o_orderkey", "o_totalprice", F.lit("host").alias("arm")).unionByName(local.select("o_orderkey", "o_totalprice", F.lit("local").alias("arm")))


@query("SELECT max(o_custkey) AS top, min(o_custkey) FILTER (o_custkey > 0) AS least, count(DISTINCT o_custkey) AS n FROM orders")
def history_boundary(spark, sf_dir):
    return t(spark, sf_dir, "orders").agg(F.max("o_custkey").alias("top"), F.min(F.when(F.col("o_custkey") > 0, F.col("o_custkey"))).alias("least"), F.countDistinct("o_custkey").alias("n"))


# --- scorers over columns at hand -------------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str, features: dict[str, str], scorer) -> DataFrame:
    rows = t(spark, sf_dir, "part").select("p_partkey", *[F.expr(x).alias(k) for k, x in features.items()])
    return rows.select("p_partkey", scorer({k: F.col(k) for k in features}).alias("r")).select("p_partkey", F.col("r.score").alias("score"))


@query(
    f"""WITH f AS (SELECT p_partkey, p_size % 4 AS tokens, p_size % 3 > 0 AS script, 10 + p_size % 12 AS digits, p_retailprice AS bytes, 1000000.0 + p_partkey * 500 AS ada FROM part),
s AS (SELECT *, {_n('digits', 13, 19)} AS d, round_even(100 * least(greatest(0.55 * {_n('digits', 13, 19)} + 0.20 * {_n('bytes', 100, 1500)} + 0.15 * (1 - {_n('ada', 1.2e6, 2e6)}), 0), 1), 2) AS raw FROM f)
SELECT p_partkey, CASE WHEN script AND tokens BETWEEN 1 AND 2 THEN CASE WHEN d < 0.05 THEN least(raw, 30) ELSE raw END ELSE -1 END AS score FROM s"""
)
def scorer_large_value(spark, sf_dir):
    f = {"tokens": "p_size % 4", "is_script": "p_size % 3 > 0", "digits": "10 + p_size % 12", "value_bytes": "p_retailprice", "ada": "1000000D + p_partkey * 500"}
    return _scored(spark, sf_dir, f, scorers.large_value)


@query(
    f"""WITH f AS (SELECT p_partkey, p_size AS tokens, p_size % 3 > 0 AS script, p_retailprice AS bytes, 1000000.0 + p_partkey * 500 AS ada, p_size % 7 = 0 AS known FROM part),
s AS (SELECT *, round_even(100 * least(greatest(0.35 * {_n('bytes', 100, 1500)} + 0.35 * {_n('tokens', 1, 20)} + 0.15 * (1 - {_n('ada', 1.2e6, 2e6)}), 0), 1), 2) AS raw FROM f)
SELECT p_partkey, CASE WHEN script AND tokens >= 2 AND (tokens >= 15 OR bytes >= 1000) THEN CASE WHEN tokens < 15 OR known THEN least(raw, 59) ELSE raw END ELSE -1 END AS score FROM s"""
)
def scorer_token_dust(spark, sf_dir):
    f = {"tokens": "p_size", "is_script": "p_size % 3 > 0", "value_bytes": "p_retailprice", "ada": "1000000D + p_partkey * 500", "all_known_old": "p_size % 7 = 0", "allowlisted": "false"}
    return _scored(spark, sf_dir, f, scorers.token_dust)


@query(
    f"""WITH f AS (SELECT p_partkey, p_size % 2 AS shared, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS o, p_retailprice AS delta, p_size % 8 AS wins, p_partkey * 3.0 AS fee, p_size * 3.0 AS ttl, p_size % 5 = 0 AS change FROM part),
s AS (SELECT *, round_even(100 * least(greatest(0.35 * o + 0.30 * {_n('(1 / greatest(delta, 1))', 0.0005, 0.005)} + 0.25 * {_n('wins', 0, 5)} + 0.10 * ((1 - {_n('fee', 500, 5000)} + 1 - {_n('ttl', 10, 100)} + change::INT) / 3), 0), 1), 2) AS raw FROM f)
SELECT p_partkey, CASE WHEN shared >= 1 THEN CASE WHEN wins < 3 AND raw >= 80 THEN 79 ELSE raw END ELSE -1 END AS score FROM s"""
)
def scorer_front_running(spark, sf_dir):
    f = {
        "shared": "p_size % 2", "outcome": "element_at(array('TX_B_CONFIRMED', 'BOTH_PENDING', 'TX_A_CONFIRMED'), p_size % 3 + 1)", "delta_ms": "p_retailprice",
        "wins": "p_size % 8", "fee_gap": "p_partkey * 3D", "ttl_gap": "p_size * 3D", "change_link": "p_size % 5 = 0",
    }
    return _scored(spark, sf_dir, f, scorers.front_running)


@query(
    f"""WITH f AS (SELECT p_partkey, 1 + p_size % 7 AS len, p_retailprice / 10000 AS loss, 0.6 + p_size / 120.0 AS sim, p_size % 9 AS rec, p_size / 50.0 AS ent, p_size % 2 = 0 AS flag, p_partkey % 100 / 100.0 AS tmp, 1.0 + p_size % 30 AS hop FROM part),
p AS (SELECT *, {_n('sim', 0.7, 0.97)} AS a, {_n('rec', 0, 5)} AS r, {_n('(1 - ent)', 0.2, 0.7)} AS e, (flag::INT + {_n('tmp', 0.3, 0.85)}) / 2 AS x, {_n('(1 / hop)', 0.05, 0.5)} AS v FROM f),
s AS (SELECT *, e + x + v < 0.1 AS bare, round_even(100 * least(greatest(0.3 * a + 0.3 * r + 0.2 * e + 0.1 * x + 0.1 * v, 0), 1), 2) AS raw FROM p)
SELECT p_partkey, CASE WHEN len BETWEEN 3 AND 6 AND loss <= len * 0.02 * 4 AND (NOT bare OR (a > 0.5 AND r > 0.5)) THEN CASE WHEN bare OR loss > 2 * 0.05 THEN least(raw, 59) ELSE raw END ELSE -1 END AS score FROM s"""
)
def scorer_circular(spark, sf_dir):
    f = {
        "length": "1 + p_size % 7", "net_loss": "p_retailprice / 10000", "similarity": "0.6D + p_size / 120D", "recurrence": "p_size % 9", "entropy": "p_size / 50D", "round_amount": "p_size % 2 = 0",
        "temporal": "p_partkey % 100 / 100D", "hop_slots": "1D + p_size % 30", "fee_ratio": "0.05D",
    }
    return _scored(spark, sf_dir, f, scorers.circular)


@query(
    f"""WITH f AS (SELECT p_partkey, p_size % 9 AS span, p_size % 2 = 0 AS linked, p_size / 200.0 AS rate, p_retailprice / 40000 AS impact, p_partkey * 4000.0 AS profit, p_size % 7 AS n FROM part)
SELECT p_partkey, CASE WHEN span <= 5 AND profit >= 200000 THEN round_even(100 * least(greatest(0.30 * linked::INT + 0.30 * {_n('rate', 0, 0.15)} + 0.20 * {_n('impact', 0, 0.05)} + 0.10 * {_n('profit', 0, 5e6)} + 0.10 * {_n('n', 0, 5)}, 0), 1), 2) ELSE -1 END AS score FROM f"""
)
def scorer_sandwich(spark, sf_dir):
    f = {"slot_span": "p_size % 9", "linked": "p_size % 2 = 0", "rate_delta": "p_size / 200D", "price_impact": "p_retailprice / 40000", "profit": "p_partkey * 4000D", "count": "p_size % 7"}
    return _scored(spark, sf_dir, f, scorers.sandwich)


_URL_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"


@query(f"SELECT page_id, {_URL_HOST} AS host, regexp_extract({_URL_HOST}, '([^.]+[.][^.]+)$', 1) AS domain, url LIKE '%#%' AS fragment FROM pages")
def url_extract(spark, sf_dir):
    first = F.get(T.urls(F.col("url")), F.lit(0))
    return t(spark, sf_dir, "pages").select("page_id", T.host(first).alias("host"), T.registrable(T.host(first)).alias("domain"), F.col("url").contains("#").alias("fragment"))


# --- payloads ---------------------------------------------------------------------------------------------------------

_BAIT = "hurry, claim your part at sundaeswop.top"


def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """network, raw_data: an order as a transaction's payload, its lines as outputs with assets. Some mint a token with a
    registered name or burn it, some carry a message with a link."""
    line = t(spark, sf_dir, "lineitem")
    script = F.when(F.col("l_partkey") % 5 == 0, "addr_test1w").otherwise("addr_test1q")
    coin = F.create_map(F.lit("lovelace"), (F.col("l_extendedprice") * 100).cast("long"))
    asset = F.create_map(F.lpad(F.hex("l_partkey"), 12, "0"), F.pow(F.lit(10.0), F.col("l_quantity") % 19).cast("long"))
    value = F.map_concat(F.create_map(F.lit("ada"), coin), F.create_map(F.lpad(F.hex("l_suppkey"), 56, "0"), asset))
    out = F.struct(F.concat(script, F.lpad(F.col("l_suppkey").cast("string"), 20, "q")).alias("address"), value.alias("value"))
    outputs = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.to_json(out).alias("o")))).alias("x"))
    rows = t(spark, sf_dir, "orders").join(outputs, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    key = F.col("o_orderkey").cast("string")
    minted = F.concat(F.lit(',"mint":{"'), F.lpad(F.hex("o_custkey"), 56, "0"), F.lit('":{"494e4459":'), (F.col("o_orderkey") % 4 - 1).cast("string"), F.lit("}}"))
    raw = F.concat(
        F.lit('{"id":"'), key, F.lit('","fee":'), F.col("o_totalprice").cast("long").cast("string"), F.when(F.col("o_orderkey") % 25 == 0, minted).otherwise(""),
        F.when(F.col("o_orderkey") % 40 == 7, f',"metadata":{{"labels":{{"674":{{"json":{{"msg":["{_BAIT[:20]}","{_BAIT[20:]}"]}}}}}}}}').otherwise(""),
        F.lit(',"inputs":[],"outputs":['), F.coalesce(F.array_join(F.transform("x", lambda o: o["o"]), ","), F.lit("")), F.lit("]}"),
    )
    return rows.select(F.lit("n").alias("network"), raw.alias("raw_data"))


def stored_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_payloads`` as a raw store keeps them."""
    return kept(spark, sf_dir, "raw_payloads", lambda s: s.put("raw_payloads", order_payloads(spark, sf_dir), 0)).read("raw_payloads")


_COIN, _POWER = "trunc(l_extendedprice * 100)::BIGINT", "(l_quantity % 19)::INT"
_HEAD = f"CASE WHEN {_COIN} < 24 THEN 1 WHEN {_COIN} < 256 THEN 2 WHEN {_COIN} < 65536 THEN 3 WHEN {_COIN} < 4294967296 THEN 5 ELSE 9 END"
# a value is a list of coin and policies: 56 and 12 characters of hex text, one asset each
_OUTPUTS = f"""o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS output_index,
concat(CASE WHEN l_partkey % 5 = 0 THEN 'addr_test1w' ELSE 'addr_test1q' END, lpad(l_suppkey::VARCHAR, 20, 'q')) AS address, l_partkey % 5 = 0 AS is_script, ({_COIN})::DOUBLE AS ada, {_POWER} + 1 AS digits,
1 + {_HEAD} + 1 + 2 + 56 + 1 + 1 + 12 + CASE WHEN {_POWER} < 2 THEN 1 WHEN {_POWER} < 3 THEN 2 WHEN {_POWER} < 5 THEN 3 WHEN {_POWER} < 10 THEN 5 ELSE 9 END AS value_bytes FROM lineitem)"""


@query(
    f"""WITH {_OUTPUTS}, v AS (SELECT *, {_n('digits', 13, 19)} AS d, round_even(100 * (0.55 * {_n('digits', 13, 19)} + 0.20 * {_n('value_bytes', 100, 1500)} + 0.15 * (1 - {_n('ada', 1.2e6, 2e6)})), 2) AS raw FROM o),
x AS (SELECT l_orderkey, max(CASE WHEN is_script THEN CASE WHEN d < 0.05 THEN least(raw, 30) ELSE raw END ELSE -1 END) AS large_value, count(DISTINCT address) AS recipients FROM v GROUP BY ALL),
y AS (SELECT o_orderkey, coalesce(large_value, -1) AS large_value, coalesce(recipients, 0) AS recipients, o_orderkey % 4 - 1 AS qty FROM orders LEFT JOIN x ON l_orderkey = o_orderkey),
z AS (SELECT *, CASE WHEN o_orderkey % 25 = 0 AND qty > 0 THEN round_even(100 * (0.6 * 0.4 + 0.4 * (0.4 * {_n('recipients', 1, 100)} + 0.3 * (1 - {_n('(qty / (recipients + 1e-6))', 100, 100000)}) + 0.2)), 2) ELSE -1 END AS fake_token,
CASE WHEN o_orderkey % 40 = 7 THEN round_even(100 * least(0.65 * (0.3 * {_n('0.9', 0, 0.85)} + 0.4 * {_n('0.3', 0, 0.3)}) + 0.35 * 0.35 * {_n('recipients', *scorers.BOOTSTRAP['url_recipients'])} + 0.25 + 0.15, 1), 2) ELSE -1 END AS phishing FROM y),
w AS (SELECT *, greatest(large_value, fake_token, phishing) AS top FROM z)
SELECT 'n' AS network, o_orderkey::VARCHAR AS tx_hash, -1.0 AS token_dust, large_value, -1.0 AS large_datum, -1.0 AS multiple_sat, -1.0 AS front_running, -1.0 AS sandwich, -1.0 AS circular, fake_token, phishing,
greatest(top, 0) AS max_score, CASE WHEN top < 0 THEN NULL WHEN large_value = top THEN 'large_value' WHEN fake_token = top THEN 'fake_token' ELSE 'phishing' END AS max_class, {_BAND.format('top')} AS risk_band,
((large_value >= 40)::INT + (fake_token >= 40)::INT + (phishing >= 40)::INT)::INT AS corroboration_count,
concat_ws(',', CASE WHEN fake_token >= 40 THEN 'fake_token' END, CASE WHEN large_value >= 40 THEN 'large_value' END, CASE WHEN phishing >= 40 THEN 'phishing' END) AS corroborating_classes FROM w"""
)
def payload_scores(spark, sf_dir):
    return score.score(stored_payloads(spark, sf_dir))


@query(
    f"""WITH {_OUTPUTS} SELECT 'n' AS network, l_orderkey::VARCHAR AS tx_hash, output_index::INT AS output_index, address, is_script, ada, 1 AS tokens, 1 AS policies, digits, value_bytes::BIGINT AS value_bytes,
0 AS datum_present, 0::BIGINT AS datum_bytes, value_bytes::BIGINT AS utxo_bytes, 0.0 AS datum_ratio FROM o WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""
)
def output_features(spark, sf_dir):
    return score.output_features(score.parse(stored_payloads(spark, sf_dir))).drop("datum_hex")


# --- clusters, which SQL can't express --------------------------------------------------------------------------------


@query()
def contract_outliers(spark, sf_dir):
    """Clusters and outliers of each segment's most recent customers."""
    rows = t(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return cluster.outliers(cluster.recent(rows, "c_mktsegment", [F.desc("c_custkey")]), "c_mktsegment", "c_custkey", ["c_acctbal", "nation"], eps=0.3)


@query()
def frozen_verdicts(spark, sf_dir):
    """A model fitted on the clusters of each segment's oldest customers, and all customers held against it. Clusters with the customers of
    least balance hand a verdict on."""
    rows = t(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    oldest = cluster.recent(rows, "c_mktsegment", ["c_custkey"])
    judged = cluster.outliers(oldest, "c_mktsegment", "c_custkey", ["c_acctbal", "nation"], eps=0.3).select("c_mktsegment", "c_custkey", "cluster")
    train = lineage.cut(oldest.join(judged, ["c_mktsegment", "c_custkey"]))
    poor = train.filter("cluster >= 0").groupBy("c_mktsegment", "cluster").agg(F.avg("c_acctbal").alias("_b")).groupBy("c_mktsegment").agg(F.min_by("cluster", "_b").alias("cluster"))
    model = frozen.fit(train, "c_mktsegment", "cluster", ["c_acctbal", "nation"], poor.withColumn("verdict", F.lit("malicious")))
    return frozen.classify(rows, model, "c_mktsegment", "c_custkey", ["c_acctbal", "nation"])
