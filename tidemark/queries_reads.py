"""Reads of scores, lifecycle, runs and labels, and jobs of upkeep, bound to the tables at hand with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as S
from tidemark.operators import joins, reads, stats, versions
from tidemark.plans import reports
from tidemark.queries import _BAND, _SCORED, money, query, scored_orders, t, total

_STORED = f"""{_SCORED}, st AS (SELECT o_orderkey, o_custkey, o_totalprice, score AS max_score, {_BAND.format('score')} AS risk_band, o_orderpriority AS max_class, o_orderdate AS analyzed_at, (o_orderkey % 4)::INT AS corroboration_count FROM s)"""


def stored_scores(spark, sf_dir, since=None, until=None):
    """Scores as a list reads them: key, score, band, dominant class and when it was analysed. Reads that have bounds open the
    files of their months."""
    return scored_orders(spark, sf_dir, since, until).select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("score").alias("max_score"), S.band(F.col("score")).alias("risk_band"), F.col("o_orderpriority").alias("max_class"),
        F.col("o_orderdate").alias("analyzed_at"), (F.col("o_orderkey") % 4).cast("int").alias("corroboration_count"),
    )


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _ts(day: str):
    return F.expr(f"timestamp_ntz'{day} 00:00:00'")


# --- lists and points -------------------------------------------------------------------------------------------------

_FILTERED = "lower(risk_band) IN ('high', 'critical') AND max_class = '2-HIGH' AND max_score >= 65 AND corroboration_count >= 2 AND analyzed_at >= TIMESTAMP '1996-01-01' AND analyzed_at < TIMESTAMP '2000-01-01'"


@query(f"WITH {_STORED} SELECT o_orderkey, max_score, risk_band FROM st WHERE {_FILTERED} AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def score_filtered(spark, sf_dir):
    """All conditions of a list of scores at once, without archived keys."""
    cond = reads.score_filter(PRIORITIES, bands=("HIGH", "Critical"), cls="2-HIGH", min_score=65, corroboration=2, since=_ts("1996-01-01"), before=_ts("2000-01-01"))
    archived = t(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return stored_scores(spark, sf_dir, "1996-01-01", "1999-12-31").filter(cond).join(archived, "o_custkey", "left_anti").select("o_orderkey", "max_score", "risk_band")


@query(
    f"""WITH {_STORED}, p AS (SELECT * FROM st WHERE max_score >= 30 ORDER BY analyzed_at DESC, max_score DESC, o_orderkey LIMIT 40 OFFSET 20)
SELECT p.o_orderkey, max_score, analyzed_at, o_totalprice AS fee, n AS output_count FROM p LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) l ON l_orderkey = p.o_orderkey"""
)
def score_page_by_date(spark, sf_dir):
    """A page by date, its rows alone enriched with fee and outputs; null outputs where there are none."""
    page = reads.page(stored_scores(spark, sf_dir).filter(reads.score_filter(PRIORITIES, min_score=30)), [F.desc("analyzed_at"), F.desc("max_score"), "o_orderkey"], 40, 20)
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(F.broadcast(page.select("o_orderkey")), "o_orderkey", "left_semi")
    counts = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("output_count"))
    return page.join(counts, "o_orderkey", "left").select("o_orderkey", "max_score", "analyzed_at", F.col("o_totalprice").alias("fee"), "output_count")


@query(f"WITH {_STORED} SELECT o_orderkey, max_score, risk_band, max_class FROM st WHERE o_orderkey = 42")
def score_point(spark, sf_dir):
    return stored_scores(spark, sf_dir).filter("o_orderkey = 42").select("o_orderkey", "max_score", "risk_band", "max_class")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AND o_orderdate >= (SELECT max(o_orderdate)::DATE FROM orders) - INTERVAL 365 DAY")
def tx_block_date(spark, sf_dir):
    """Days of some keys' blocks, in a window that begins at the start of a day."""
    o = t(spark, sf_dir, "orders")
    some = t(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    start = o.agg((F.date_trunc("day", F.max("o_orderdate")) - F.expr("interval 365 days")).cast("timestamp_ntz").alias("start"))
    return o.crossJoin(F.broadcast(start)).filter(F.col("o_orderdate") >= F.col("start")).join(some, "o_orderkey", "left_semi").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1996-06-01') AS inclusive, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-06-01') AS half_open FROM orders")
def archive_count(spark, sf_dir):
    """Counts and exports include the upper bound, lists don't."""
    at = F.col("o_orderdate")
    return t(spark, sf_dir, "orders").agg(F.count_if((at >= _ts("1996-03-01")) & (at <= _ts("1996-06-01"))).alias("inclusive"), F.count_if((at >= _ts("1996-03-01")) & (at < _ts("1996-06-01"))).alias("half_open"))


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def lifecycle_list(spark, sf_dir):
    return reads.page(t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 50, 50)


@query(
    """WITH f AS (SELECT event_id, user_id, event_type FROM events WHERE event_type NOT IN ('view', 'click') ORDER BY ts DESC, event_id DESC LIMIT 10000)
SELECT user_id, count(*) AS n, list(event_type ORDER BY event_id) AS verdicts FROM f GROUP BY ALL"""
)
def flagged_verdicts(spark, sf_dir):
    """The newest flagged verdicts, 10,000 at most as the read defines it, by transaction."""
    flagged = reads.page(t(spark, sf_dir, "events").filter(~F.col("event_type").isin("view", "click")), [F.desc("ts"), F.desc("event_id")], 10_000)
    own = F.sort_array(F.collect_list(F.struct("event_id", "event_type")))
    return flagged.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), own.alias("x")).select("user_id", "n", F.col("x.event_type").alias("verdicts"))


@query("SELECT max(ts) AS heartbeat FROM events WHERE event_type = 'purchase'")
def heartbeat(spark, sf_dir):
    return t(spark, sf_dir, "events").filter("event_type = 'purchase'").agg(F.max("ts").alias("heartbeat"))


@query("SELECT user_id, arg_max(props, (ts, event_id)) AS state, max(ts) AS updated_at FROM events GROUP BY ALL")
def entity_state(spark, sf_dir):
    """A key's state is the newest JSON that was set."""
    order = F.struct("ts", "event_id")
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("props", order).alias("state"), F.max("ts").alias("updated_at"))


@query("SELECT o_custkey, o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def runs_page(spark, sf_dir):
    """A page of runs, newest first, with how many there are."""
    rows = t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    page = reads.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, 40)
    return page.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))).select("o_custkey", "o_orderkey", "total")


# --- joins ------------------------------------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, max((l_shipdate, l_extendedprice)) AS v FROM lineitem GROUP BY ALL)
SELECT count(*) AS n, sum(v[2]::DECIMAL(18,2))::DOUBLE AS total FROM f JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'"""
)
def feature_window_join(spark, sf_dir):
    """Newest features of transactions of a window of chain time; both sides are one row a key before they meet."""
    newest = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_shipdate", "l_extendedprice")).alias("v"))
    txs = t(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= _ts("1998-01-01")) & (F.col("o_orderdate") < _ts("1999-01-01"))).select(F.col("o_orderkey").alias("l_orderkey"))
    return newest.join(txs, "l_orderkey").agg(F.count(F.lit(1)).alias("n"), total(F.col("v.l_extendedprice")).alias("total"))


@query(f"WITH {_STORED} SELECT max_class, count(DISTINCT st.o_orderkey) AS n FROM st JOIN lineitem ON l_orderkey = st.o_orderkey WHERE max_score >= 60 AND l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY ALL")
def alerts_by_chain_time(spark, sf_dir):
    txs = t(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= _ts("1997-01-01")).select(F.col("l_orderkey").alias("o_orderkey"))
    return stored_scores(spark, sf_dir).filter("max_score >= 60").join(txs, "o_orderkey", "left_semi").groupBy("max_class").agg(F.countDistinct("o_orderkey").alias("n"))


@query(
    f"""WITH {_STORED}, c AS (SELECT o_custkey, o_orderkey, analyzed_at FROM st WHERE max_score >= 60)
SELECT a.o_orderkey, count(DISTINCT b.o_orderkey) AS recurrence FROM c a JOIN c b ON b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey AND b.analyzed_at <= a.analyzed_at AND b.analyzed_at > a.analyzed_at - INTERVAL 30 DAY GROUP BY ALL"""
)
def recurrence(spark, sf_dir):
    """Earlier findings of an origin in 30 days, itself left out; those without any don't appear. Findings are counted by
    instant first and then summed over a range of time, so that a busy origin gives no pairs."""
    found = stored_scores(spark, sf_dir).filter("max_score >= 60").select("o_custkey", "o_orderkey", F.unix_micros(F.col("analyzed_at").cast("timestamp")).alias("at"))
    return joins.earlier_in_range(found, "o_custkey", "at", 30 * 86_400_000_000 - 1).filter("earlier > 1").select("o_orderkey", (F.col("earlier") - 1).alias("recurrence"))


@query("SELECT e.event_id, (SELECT count(*) FROM events h WHERE h.user_id = e.user_id AND h.event_type = 'error' AND epoch_us(h.ts) < epoch_us(e.ts)) AS earlier FROM events e WHERE e.event_type = 'purchase'")
def attacker_history(spark, sf_dir):
    """How often a row's actor was seen before it: a running sum for each actor, not a join of all pairs."""
    e = t(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return joins.seen_before(e, "user_id", "at", F.col("event_type") == "error", "earlier").filter("event_type = 'purchase'").select("event_id", "earlier")


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase'),
p AS (SELECT a.event_id AS a, b.event_id AS b, b.at - a.at AS d FROM e a JOIN e b ON a.user_id = b.user_id AND (a.at, a.event_id) < (b.at, b.event_id) AND b.at - a.at <= 86400000000),
x AS (SELECT a AS tx, b AS counterpart, d FROM p UNION ALL SELECT b, a, d FROM p)
SELECT e.event_id AS tx, arg_min(counterpart, (d, counterpart)) AS counterpart, coalesce(min(d), -1)::DOUBLE AS delta FROM e LEFT JOIN x ON x.tx = e.event_id GROUP BY ALL"""
)
def collision_enrich(spark, sf_dir):
    """Each transaction with the one that collides with it within a day and is nearest in time, from either side; null and -1 where none does."""
    e = t(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    pairs = joins.shared_reference_pairs(e, "event_id", "user_id", "at", 86_400_000_000).select("tx_a", "tx_b", "delta")
    sides = pairs.select(F.inline(F.array(F.struct(F.col("tx_a").alias("tx"), F.col("tx_b").alias("counterpart"), "delta"), F.struct(F.col("tx_b").alias("tx"), F.col("tx_a").alias("counterpart"), "delta"))))
    first = sides.groupBy("tx").agg(F.min(F.struct("delta", "counterpart")).alias("m"))
    return e.select(F.col("event_id").alias("tx")).join(first, "tx", "left").select("tx", F.col("m.counterpart").alias("counterpart"), F.coalesce("m.delta", F.lit(-1.0)).alias("delta"))


@query(
    """SELECT o_orderkey, coalesce(f.n, 0)::BIGINT AS redeemers, coalesce(a.n, 0)::BIGINT AS assets FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) f ON f.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL) a ON a.l_orderkey = o_orderkey"""
)
def sidecar_shape(spark, sf_dir):
    """A transaction with script features and distinct assets, each reduced before it is joined; none counts as 0."""
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("redeemers"), F.countDistinct("l_partkey").alias("assets"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return t(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", zero("redeemers"), zero("assets"))


@query("SELECT c_custkey, e.vec_id IS NULL AS unscored, e.label FROM customer LEFT JOIN embeddings e ON e.vec_id = c_custkey")
def classified_or_not(spark, sf_dir):
    """Null is not scored yet; cluster 0 is a cluster."""
    own = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("c_custkey"), "label", F.lit(True).alias("there"))
    return t(spark, sf_dir, "customer").join(own, "c_custkey", "left").select("c_custkey", F.col("there").isNull().alias("unscored"), "label")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.05)")
def unclassified(spark, sf_dir):
    """Of a window what neither the model has classified nor a run has labelled."""
    key = F.col("l_orderkey").alias("o_orderkey")
    lines = t(spark, sf_dir, "lineitem")
    rows = t(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= _ts("1999-01-01")).select("o_orderkey")
    return reads.unprocessed(rows, [lines.filter("l_discount > 0.05").select(key), lines.filter("l_tax > 0.05").select(key)], ["o_orderkey"])


@query(
    """WITH block AS (SELECT o_orderkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL), house AS (SELECT l_orderkey AS k, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT o_orderkey, coalesce(block.v, house.v) AS amount FROM orders LEFT JOIN block ON block.k = o_orderkey LEFT JOIN house ON house.k = o_orderkey"""
)
def input_resolution(spark, sf_dir):
    """An input's amount: from the same block where it is made there, else from the store, else null."""
    block = t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy("o_orderkey").agg(F.min("o_totalprice").alias("amount"))
    house = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("amount"))
    return t(spark, sf_dir, "orders").select("o_orderkey").join(reads.by_priority([block, house], ["o_orderkey"]), "o_orderkey", "left")


# --- aggregates and reports -------------------------------------------------------------------------------------------


@query("WITH k AS (SELECT user_id, unnest(json_keys(props)) AS k, props FROM events) SELECT user_id, count(DISTINCT k || ':' || json_extract_string(props, k)) AS n FROM k GROUP BY ALL")
def json_key_counts(spark, sf_dir):
    """Distinct entries of JSON objects by key."""
    e = t(spark, sf_dir, "events").select("user_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return e.groupBy("user_id").agg(F.countDistinct(F.concat_ws(":", "k", "v")).alias("n"))


@query(
    """WITH c AS (SELECT label - 1 AS cluster, count(*) AS size, round(avg(embedding[2]::DOUBLE), 5) AS mean FROM embeddings GROUP BY ALL)
SELECT cluster, size, mean, row_number() OVER (ORDER BY (cluster = -1)::INT, size DESC, cluster)::INT AS place FROM c"""
)
def clusters_in_order(spark, sf_dir):
    """Clusters by size, noise last. The window is over clusters, not rows."""
    from pyspark.sql import Window as W

    c = t(spark, sf_dir, "embeddings").groupBy((F.col("label") - 1).alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.round(F.avg(F.get("embedding", F.lit(1)).cast("double")), 5).alias("mean"))
    return c.withColumn("place", F.row_number().over(W.orderBy((F.col("cluster") == -1).cast("int"), F.desc("size"), "cluster")))



@query(
    f"""WITH {_STORED}, w AS (SELECT * FROM st WHERE analyzed_at >= TIMESTAMP '1998-01-01' AND analyzed_at < TIMESTAMP '1998-02-01')
SELECT 'band' AS kind, risk_band AS name, count(*)::DOUBLE AS n FROM w GROUP BY ALL UNION ALL SELECT 'archived', 'customers', count(*)::DOUBLE FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'top', o_orderkey::VARCHAR, max_score FROM (SELECT * FROM w ORDER BY max_score DESC, o_orderkey LIMIT 5)"""
)
def period_report(spark, sf_dir):
    """A period's report: counts by band, archived contracts and the top five."""
    window = stored_scores(spark, sf_dir, "1998-01-01", "1998-01-31").filter(reads.score_filter(PRIORITIES, since=_ts("1998-01-01"), before=_ts("1998-02-01")))
    bands = window.groupBy(F.col("risk_band").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("band").alias("kind"), "name", "n")
    archived = t(spark, sf_dir, "customer").filter("c_acctbal < 0").agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("archived").alias("kind"), F.lit("customers").alias("name"), "n")
    top = reads.page(window, [F.desc("max_score"), "o_orderkey"], 5).select(F.lit("top").alias("kind"), F.col("o_orderkey").cast("string").alias("name"), F.col("max_score").alias("n"))
    return bands.unionByName(archived).unionByName(top)


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_suppkey LIMIT 50")
def target_counts(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(50)


@query(
    f"""WITH {_STORED}, a AS (SELECT o_orderkey AS k, max_score AS v, 'host' AS src FROM st ORDER BY max_score DESC, o_orderkey LIMIT 20),
side AS (SELECT l_orderkey AS k, max(l_quantity) * 2 AS v, 'sidecar' AS src FROM lineitem GROUP BY l_orderkey ORDER BY v DESC, k LIMIT 20)
SELECT k, v, src FROM (SELECT * FROM a UNION ALL SELECT * FROM side) ORDER BY v DESC, src, k LIMIT 20"""
)
def top_merged(spark, sf_dir):
    """The best of two sources, each cut to as many before they meet."""
    a = reads.page(stored_scores(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.col("max_score").alias("v")), [F.desc("v"), "k"], 20)
    b = reads.page(t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.max("l_quantity") * 2).alias("v")), [F.desc("v"), "k"], 20)
    return reads.page(a.withColumn("src", F.lit("host")).unionByName(b.withColumn("src", F.lit("sidecar"))), [F.desc("v"), "src", "k"], 20)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY CASE WHEN c_nationkey = 0 THEN 1 ELSE 0 END, c_acctbal DESC, c_custkey LIMIT 200")
def reranked(spark, sf_dir):
    """By effective score after the merge; what could not be clustered comes last."""
    c = t(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return reads.page(c, [F.when(F.col("c_nationkey") == 0, 1).otherwise(0), F.desc("c_acctbal"), "c_custkey"], 200).select("c_custkey", "c_acctbal")



@query(
    """WITH f AS (SELECT unnest(['price', 'unknown']) AS feature), q AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS l FROM lineitem GROUP BY ALL),
sc AS (SELECT l_suppkey, l[floor(0.5 * len(l))::BIGINT + 1] AS p50, l[floor(0.99 * len(l))::BIGINT + 1] AS p99, len(l) AS n FROM q),
g AS (SELECT list_sort(list(l_extendedprice)) AS l FROM lineitem), gl AS (SELECT l[floor(0.5 * len(l))::BIGINT + 1] AS p50, l[floor(0.99 * len(l))::BIGINT + 1] AS p99 FROM g)
SELECT s_suppkey AS l_suppkey, feature, CASE WHEN feature = 'unknown' THEN 'missing' WHEN sc.n >= 600 THEN 'scope' ELSE 'global' END AS tier,
CASE WHEN feature = 'unknown' THEN 0 WHEN sc.n >= 600 THEN sc.p50 ELSE gl.p50 END AS p50, CASE WHEN feature = 'unknown' THEN 1 WHEN sc.n >= 600 THEN sc.p99 ELSE gl.p99 END AS p99
FROM supplier CROSS JOIN f CROSS JOIN gl LEFT JOIN sc ON sc.l_suppkey = s_suppkey"""
)
def baseline_tiers(spark, sf_dir):
    """A scope's baseline, else the one of everywhere, else none (0 and 1)."""
    lines, levels = t(spark, sf_dir, "lineitem"), {"p50": 0.5, "p99": 0.99}
    own = stats.exact_percentiles(lines, ["l_suppkey"], "l_extendedprice", levels).withColumn("feature", F.lit("price"))
    every = stats.exact_percentiles(lines, [], "l_extendedprice", levels).withColumn("feature", F.lit("price"))
    rows = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.explode(F.array(F.lit("price"), F.lit("unknown"))).alias("feature"))
    return reads.resolved_baseline(rows, own, every, "l_suppkey", "feature", F.col("n") >= 600)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 'override' WHEN s_nationkey IN (1, 2) THEN 'dex' WHEN s_nationkey = 3 THEN 'lending' END AS label FROM supplier")
def label_map(spark, sf_dir):
    """Labels of contracts by script: of the registry the first, then overrides."""
    registry = spark.createDataFrame([(1, "dex", 0), (2, "dex", 1), (3, "lending", 2), (1, "lending", 3)], "s_nationkey int, label string, place int").groupBy("s_nationkey").agg(F.min_by("label", "place").alias("label"))
    rows = t(spark, sf_dir, "supplier").join(F.broadcast(registry), "s_nationkey", "left")
    return rows.select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 3, "override").otherwise(F.col("label")).alias("label"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, (epoch_us(ts) // 1000000)::BIGINT AS seconds FROM events")
def iso_dates(spark, sf_dir):
    """Times without a zone are UTC."""
    at = F.col("ts").cast("timestamp")
    return t(spark, sf_dir, "events").select("event_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.unix_seconds(at).alias("seconds"))


# --- models, labels and upkeep ----------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT label, avg((embedding[1] > 0.1)::INT) AS drift, count(*) / 60.0 AS coverage, max(vec_id) AS last FROM embeddings GROUP BY ALL)
SELECT label, CASE WHEN coverage < 0.6 THEN 'wait' WHEN drift >= 0.25 AND last >= 100 THEN 'refit' ELSE 'keep' END AS decision FROM w"""
)
def refit_decision(spark, sf_dir):
    """A model is fitted anew where rows drift, enough of them are covered and the last fit is long enough ago."""
    w = t(spark, sf_dir, "embeddings").groupBy("label").agg(F.avg((F.get("embedding", F.lit(0)) > F.lit(0.1).cast("double")).cast("int")).alias("drift"), (F.count(F.lit(1)) / 60.0).alias("coverage"), F.max("vec_id").alias("last"))
    return w.select("label", S.refit(F.col("drift"), F.col("coverage"), F.col("last") >= 100).alias("decision"))


@query("WITH x AS (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, (ts, event_id)) AS label FROM events GROUP BY ALL) SELECT user_id, label FROM x WHERE label <> ''")
def current_labels(spark, sf_dir):
    """The newest label a key was given; a cleared one is none."""
    e = t(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("label"))
    latest = e.groupBy("user_id").agg(F.max_by(F.struct("label"), "at").alias("x")).select("user_id", F.lit(1).alias("at"), F.col("x.label").alias("label"))
    return reads.labels(latest, ["user_id"], "at", "label")


@query(
    f"""WITH {_STORED}, v AS (SELECT l_orderkey AS k, max(CASE WHEN l_quantity > 49 THEN 80.0 ELSE 0 END) AS ca FROM lineitem GROUP BY ALL),
e AS (SELECT greatest(max_score, coalesce(ca, 0)) AS eff, max_score FROM st LEFT JOIN v ON k = o_orderkey)
SELECT {_BAND.format('eff')} AS band, count(*) AS n, count(*) FILTER ({_BAND.format('eff')} <> {_BAND.format('max_score')}) AS rescued FROM e GROUP BY ALL"""
)
def overlay_stats(spark, sf_dir):
    """Counts by band after verdicts have raised scores, and how many came into their band by that."""
    own = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_quantity") > 49, 80.0).otherwise(0.0)).alias("ca"))
    rows = stored_scores(spark, sf_dir).join(own, "o_orderkey", "left")
    band = S.band(F.greatest("max_score", F.coalesce("ca", F.lit(0.0))))
    return rows.select(band.alias("band"), "risk_band").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("band") != F.col("risk_band")).alias("rescued"))


@query(
    """SELECT e.event_id FROM events e WHERE ts >= (SELECT max(ts) - INTERVAL 120 SECOND FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-20') AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-20')"""
)
def watermark_poll(spark, sf_dir):
    """What to analyse next: from the newest row done less an overlap, without those done."""
    e = t(spark, sf_dir, "events")
    done = e.filter((F.col("event_type") == "purchase") & (F.col("ts") < _ts("2024-01-20"))).select("event_id", F.col("ts").alias("done_at"))
    return reads.unprocessed(reads.since_watermark(e, "ts", done, "done_at", "120 seconds"), [done], ["event_id"]).select("event_id")


@query(
    """WITH a AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events WHERE value > 30)
SELECT user_id, event_type, CASE WHEN max(attempt) >= 3 THEN 'degraded' ELSE 'retry' END AS state, least(max(attempt), 3)::INT AS attempts FROM a GROUP BY ALL"""
)
def retry_state(spark, sf_dir):
    """A row that fails is tried three times and then scored without what is missing."""
    n = t(spark, sf_dir, "events").filter("value > 30").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "event_type", F.when(F.col("n") >= 3, "degraded").otherwise("retry").alias("state"), F.least("n", F.lit(3)).cast("int").alias("attempts"))


@query(
    """WITH k AS (SELECT l_orderkey, l_partkey AS policy FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT policy, min(o_orderdate) AS first_slot FROM k JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL"""
)
def policy_backfill(spark, sf_dir):
    """First seen of policies in outputs and mints, from what is stored."""
    lines = t(spark, sf_dir, "lineitem")
    keys = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("policy"))
    return versions.first_seen(keys.join(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey"), "policy", "o_orderdate")


@query("SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN 'Informational' ELSE c_mktsegment END AS band FROM customer")
def relabelled(spark, sf_dir):
    """An old name of a band is read as the new one."""
    band = F.col("c_mktsegment")
    return t(spark, sf_dir, "customer").select("c_custkey", F.when(F.lower(band) == "building", "Informational").otherwise(band).alias("band"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900))")
def contract_cascade(spark, sf_dir):
    """Deleting a contract takes its runs and their rows."""
    gone = t(spark, sf_dir, "customer").filter("c_acctbal < -900").select(F.col("c_custkey").alias("o_custkey"))
    runs = t(spark, sf_dir, "orders").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return versions.without_keys(t(spark, sf_dir, "lineitem"), runs, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < (SELECT min(l_shipdate) + INTERVAL 500 DAY FROM lineitem)")
def history_below_floor(spark, sf_dir):
    """History is written below the place where live rows begin."""
    floor = t(spark, sf_dir, "lineitem").agg((F.min("l_shipdate") + F.expr("interval 500 days")).alias("floor"))
    return t(spark, sf_dir, "orders").crossJoin(F.broadcast(floor)).filter(F.col("o_orderdate") < F.col("floor")).select("o_orderkey", "o_orderdate")


@query("SELECT o_custkey, max(o_orderdate) AS slot FROM orders GROUP BY ALL HAVING max(o_orderdate) > TIMESTAMP '2000-06-01' ORDER BY slot, o_custkey LIMIT 1000")
def host_cursor_page(spark, sf_dir):
    """A page of keys by ascending newest slot, after the cursor of the last page."""
    newest = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("slot"))
    return reads.page(newest.filter(F.col("slot") > _ts("2000-06-01")), ["slot", "o_custkey"], 1000)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate IN (SELECT o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 9000)) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def address_backfill(spark, sf_dir):
    """The blocks that an address appears in, whole, without what is stored already."""
    own = t(spark, sf_dir, "customer").filter("c_nationkey = 3 AND c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    orders = t(spark, sf_dir, "orders")
    blocks = orders.join(own, "o_custkey", "left_semi").select("o_orderdate").distinct()
    have = t(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return reads.unprocessed(orders.join(blocks, "o_orderdate", "left_semi"), [have], ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(f"WITH {_STORED} SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN round(least(100, max_score + 5), 2) ELSE max_score END AS max_score, CASE WHEN o_totalprice > 200000 THEN 2 ELSE 1 END AS version FROM st")
def rescored(spark, sf_dir):
    """Rows that are scored anew get a newer version, which is the one that is read."""
    old = stored_scores(spark, sf_dir).select("o_orderkey", "o_totalprice", "max_score", F.lit(1).alias("version"))
    new = old.filter("o_totalprice > 200000").withColumns({"max_score": F.round(F.least(F.lit(100.0), F.col("max_score") + 5), 2), "version": F.lit(2)})
    return versions.latest_by_key(old.unionByName(new), ["o_orderkey"], "version", ["max_score"]).select("o_orderkey", "max_score", "version")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, (epoch_us(ts) // 3600000000)::BIGINT AS h FROM events) GROUP BY ALL")
def seen_once(spark, sf_dir):
    """Repeats of a key within its window count once."""
    e = t(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("h")).distinct()
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey, sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -l_extendedprice END::DECIMAL(18,2))::DOUBLE AS profit FROM lineitem GROUP BY ALL")
def bracket_profit(spark, sf_dir):
    """What an actor took out of a pool less what it put in."""
    signed = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(money(signed)).cast("double").alias("profit"))


# --- reports ----------------------------------------------------------------------------------------------------------

_CLASS_COLUMNS = tuple(f"p{i}" for i in range(1, 6))
_SINCE, _BEFORE = "1997-01-01", "1997-07-01"
_INSIDE = f">= TIMESTAMP '{_SINCE}' AND {{0}} < TIMESTAMP '{_BEFORE}'"
_in = lambda c: f"{c} {_INSIDE.format(c)}"


def _report_scores(spark, sf_dir):
    """Stored scores as a report reads them: a class by its number, and the columns of an export."""
    rows = stored_scores(spark, sf_dir, _SINCE, _BEFORE).withColumn("max_class", F.concat(F.lit("p"), F.substring("max_class", 1, 1)))
    own = {c: F.when(F.col("max_class") == c, F.col("max_score")) for c in _CLASS_COLUMNS}
    subs = F.create_map("max_class", F.create_map(F.lit("band"), F.col("corroboration_count")))
    return rows.withColumns(own | {"tx_hash": F.col("o_orderkey").cast("string"), "network": F.lit("n"), "fee": F.col("o_custkey"), "output_count": F.col("corroboration_count"), "sub_scores": subs, "analysis_version": F.lit("1")})


def _report_verdicts(spark, sf_dir):
    """Lines as a transaction's verdicts by contract: scored when they were shipped, published when they were received."""
    score_ = (F.col("l_quantity") * 2).cast("double")
    return t(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("tx_hash"), score_.alias("score"), S.band(score_).alias("risk_band"), F.col("l_shipdate").alias("scored_at"), (F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber").cast("int") * 10)).alias("published_at"))


_REPORT = f"""{_STORED}, w AS (SELECT *, 'p' || max_class[1] AS cls FROM st WHERE {_in('analyzed_at')}),
v AS (SELECT 't' || l_orderkey AS tx_hash, (l_quantity * 2)::DOUBLE AS score, l_shipdate::TIMESTAMP AS scored_at, l_shipdate::TIMESTAMP + to_days(10 * l_linenumber::INT) AS published_at FROM lineitem),
vb AS (SELECT tx_hash, max(score) AS score, arg_min(scored_at, (-score, scored_at)) AS scored_at, bool_or({_in('published_at')}) AS p FROM v GROUP BY ALL),
x AS (SELECT *, {_BAND.format('score')} AS risk_band FROM vb WHERE (p OR ({_in('scored_at')})) AND score >= 60)"""


@query(
    f"""WITH {_REPORT}, a AS (SELECT count(*) AS n FROM orders WHERE {_in('o_orderdate')} AND o_orderkey % 10 = 0)
SELECT 'total' AS section, 'scored' AS name, count(*) AS n FROM w UNION ALL SELECT 'band', band, count(w.o_orderkey) FROM (SELECT unnest(['Informational', 'Moderate', 'High', 'Critical']) AS band) LEFT JOIN w ON risk_band = band GROUP BY band
UNION ALL SELECT 'class', c, count(w.o_orderkey) FILTER (c <> 'p5') FROM (SELECT unnest(['p1', 'p2', 'p3', 'p4', 'p5']) AS c) LEFT JOIN w ON cls = c AND risk_band IN ('High', 'Critical') GROUP BY c
UNION ALL SELECT 'class', 'contract_anomaly', count(*) FROM x UNION ALL SELECT 'archived', 'false_positives', n FROM a"""
)
def report_summary(spark, sf_dir):
    """Half a year's report of bands from High on, without one class, with the findings of contracts among the classes."""
    archived = t(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderdate").alias("archived_at"))
    return reports.summary(_report_scores(spark, sf_dir), archived, _report_verdicts(spark, sf_dir), _ts(_SINCE), _ts(_BEFORE), _CLASS_COLUMNS, "High", (*_CLASS_COLUMNS[:4], reports.ANOMALY))


@query(
    f"""WITH {_REPORT} SELECT * FROM (SELECT o_orderkey::VARCHAR AS tx_hash, cls AS attack_class, max_score AS risk_score, risk_band, analyzed_at::TIMESTAMP AS at FROM w WHERE risk_band IN ('High', 'Critical')
UNION ALL SELECT tx_hash, 'contract_anomaly', score, risk_band, scored_at FROM x) ORDER BY risk_score DESC, attack_class, tx_hash LIMIT 200"""
)
def report_worst(spark, sf_dir):
    rows = reports.worst(_report_scores(spark, sf_dir), _report_verdicts(spark, sf_dir), _ts(_SINCE), _ts(_BEFORE), "High", most=200)
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    f"""WITH {_REPORT} SELECT o_orderkey::VARCHAR AS tx_hash, analyzed_at, 'n' AS network, cls AS max_class, max_score, risk_band, o_custkey / 1000000 AS fee_ada, corroboration_count AS output_count,
{', '.join(f"CASE WHEN cls = '{c}' THEN max_score ELSE -1 END AS score_{c}" for c in _CLASS_COLUMNS)}, '{{"band":' || corroboration_count || '}}' AS sub_scores, '1' AS analysis_version FROM w WHERE risk_band IN ('Moderate', 'High', 'Critical')"""
)
def report_export(spark, sf_dir):
    """The rows of a report's table, for every alert of the period."""
    return reports.export(_report_scores(spark, sf_dir), _ts(_SINCE), _ts(_BEFORE), _CLASS_COLUMNS)
