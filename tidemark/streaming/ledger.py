"""Streams of blocks and pending transactions.

Writes are batches that may be repeated, and reads take newest rows (``operators.versions``), so a replayed batch changes
nothing. Rollbacks are rows of a log that reads apply. Nothing is dropped for being late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.plans.score import parse, quarantine, with_outputs

EVENT = "direction string, network string, slot long, block_hash string, height long, ts timestamp, txs array<string>"
TTL_SECONDS = 7200
#: Longer than blocks may be rolled back.
SETTLED_SECONDS = 172_800
COLLIDES = "ref string, tx_a string, tx_b string, at double, delta double"
LIFE = "tx_id string, status string, first_seen timestamp, confirmed_at timestamp, latency_ms long"


def poisoned(rows: DataFrame, work: Callable[[DataFrame], DataFrame], key: str) -> DataFrame | None:
    """``key``, reason of the rows for which ``work`` fails, None where there are none. The range of the keys (hashes) is halved as long as a part
    fails, so that a faulty row among n costs about log2(n) runs."""
    spark, found, parts = rows.sparkSession, [], [rows]
    while parts:
        part = parts.pop()
        try:
            work(part).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001  whatever a payload's features fail with, the others go on
            lo, hi = part.agg(F.min(key), F.max(key)).first()
            if lo == hi:
                found.append((lo, str(e).strip().splitlines()[0][:300]))
            else:
                mid = (lo + hi) // 2
                parts += [part.filter(F.col(key) <= mid), part.filter(F.col(key) > mid)]
    return spark.createDataFrame(found, f"{key} long, reason string") if found else None


def features_of(txs: DataFrame, *more: str) -> DataFrame:
    """A row for each output with what the output scorers read, beside ``more`` columns of its transaction; a payload is read once."""
    return with_outputs(txs).select("network", "tx_hash", *more, F.explode("outs").alias("o")).select("network", "tx_hash", *more, "o.*").drop("names", "owners")


def ingest(spark: SparkSession, source: DataFrame, root: str, now=F.current_timestamp, features=features_of) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` step of a block stream with columns EVENT: writes transactions, inputs, outputs, features,
    addresses, parse failures and rollbacks below ``root``, each batch to folders of its own that a replay replaces. The raw payloads go first,
    the rollback log last. A payload whose features fail is written whole but for them, with the reason among the failures."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:

            def put(df: DataFrame, name: str) -> None:
                df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")

            forward = batch.filter("direction = 'forward'").select("network", "slot", "block_hash", "height", "ts", F.posexplode_outer("txs").alias("block_index", "raw_data"))
            forward = forward.filter("raw_data IS NOT NULL").withColumn("ingestion_timestamp", now()).withColumn("_k", F.xxhash64("network", "slot", "block_index", "raw_data"))
            put(forward.select("network", "slot", "block_index", "raw_data", "ingestion_timestamp"), "raw")
            txs = parse(forward)
            failed = quarantine(txs).select("network", "slot", "raw_data", F.lit("payload can't be read").alias("reason"))
            txs = txs.filter("tx_hash IS NOT NULL")
            head = ["network", "tx_hash", "slot", "ingestion_timestamp"]
            put(txs.select(*head, "height", "block_hash", "block_index", "ts", "fee", "input_count", "output_count", "total_output_value", "script_valid"), "transactions")
            put(txs.select(*head, F.posexplode("inputs").alias("input_index", "i")).select(*head, "input_index", "i.*").drop("assets"), "transaction_inputs")
            put(txs.select(*head, F.explode("outputs").alias("o")).select(*head, "o.output_index", "o.address", "o.amount", "o.is_collateral"), "transaction_outputs")
            put(txs.select(*head, F.explode("addresses").alias("address")), "address_transactions")
            try:
                put(features(txs, "slot", "ingestion_timestamp"), "utxo_features")
            except Exception:  # noqa: BLE001  the payloads at fault are sought, the others' features written
                bad = poisoned(forward, lambda rows: features(parse(rows), "slot", "ingestion_timestamp"), "_k")
                if bad is None:
                    raise
                bad = F.broadcast(bad)  # as many rows as faults were met one by one
                put(features(parse(forward.join(bad.select("_k"), "_k", "left_anti")), "slot", "ingestion_timestamp"), "utxo_features")
                failed = failed.unionByName(forward.join(bad, "_k").select("network", "slot", "raw_data", "reason"))
            put(failed, "failed")
            put(batch.filter("direction = 'backward'").select("network", "slot", now().alias("at")), "rollbacks")
        finally:
            batch.unpersist()

    return step


def pending_collisions(seen: DataFrame, ttl: int = TTL_SECONDS, idle: int = 2 * TTL_SECONDS) -> DataFrame:
    """Streaming: COLLIDES for each pair of pending transactions (tx, at, refs) that spend one reference within ``ttl``
    seconds. State by reference: the transactions that wait for it, dropped as they grow old, and altogether where nothing
    spends the reference for ``idle`` seconds of processing time."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: list[tuple[str, float]] = list(zip(*state.get)) if state.exists else []
        out = []
        for pdf in frames:
            for tx, at in pdf[["tx", "at"]].drop_duplicates("tx").sort_values(["at", "tx"]).itertuples(index=False):
                held = [(t, a) for t, a in held if at - a <= ttl]
                if any(t == tx for t, _ in held):
                    continue
                out += [(key[0], t, tx, at, at - a) for t, a in held]
                held.append((tx, at))
        if held:
            state.update(tuple(map(list, zip(*held))))
            state.setTimeoutDuration(idle * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["ref", "tx_a", "tx_b", "at", "delta"])

    rows = seen.select("tx", F.col("at").cast("double").alias("at"), F.explode("refs").alias("ref"))
    return rows.groupBy("ref").applyInPandasWithState(step, COLLIDES, "txs array<string>, ats array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def lifecycle_stream(events: DataFrame, ttl: int = TTL_SECONDS, settled: int = SETTLED_SECONDS) -> DataFrame:
    """Streaming: LIFE rows as a transaction's events (tx_id, event, at; event seen, confirmed or rolled_back) change its
    status; one that is only seen is DROPPED after ``ttl`` seconds of processing time. Any other is forgotten after ``settled``
    seconds without an event; a rollback that comes later is seen by ``lifecycle`` alone."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, first, confirmed = state.get if state.exists else (None, None, None)
        if state.hasTimedOut:
            state.remove()
            if status != "PENDING":
                return
            yield pd.DataFrame([(key[0], "DROPPED", pd.Timestamp(first, unit="us") if first else None, None, None)], columns=["tx_id", "status", "first_seen", "confirmed_at", "latency_ms"])
            return
        was = status
        for pdf in frames:
            for event, at in pdf[["event", "at"]].sort_values("at").itertuples(index=False):
                us = int(pd.Timestamp(at).value // 1000)
                if event == "seen":
                    first, status = first or us, status or "PENDING"
                elif event == "confirmed":
                    confirmed, status = us, "CONFIRMED"
                elif event == "rolled_back" and status == "CONFIRMED":
                    status = "ROLLED_BACK"
        state.update((status, first, confirmed))
        state.setTimeoutDuration((ttl if status == "PENDING" else settled) * 1000)
        stamp = lambda us: pd.Timestamp(us, unit="us") if us else None
        rows = [(key[0], status, stamp(first), stamp(confirmed), (confirmed - first) // 1000 if first and confirmed else None)] if status != was else []
        yield pd.DataFrame(rows, columns=["tx_id", "status", "first_seen", "confirmed_at", "latency_ms"])

    return events.groupBy("tx_id").applyInPandasWithState(step, LIFE, "status string, first long, confirmed long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def lifecycle(events: DataFrame) -> DataFrame:
    """The same statuses by a batch fold over the event log (tx_id, event, at)."""
    at = lambda e, f: f(F.when(F.col("event") == e, F.col("at")))
    rows = events.groupBy("tx_id").agg(at("seen", F.min).alias("first_seen"), at("confirmed", F.max).alias("confirmed_at"), at("rolled_back", F.max).alias("back"))
    status = F.when(F.col("back") > F.col("confirmed_at"), "ROLLED_BACK").when(F.col("confirmed_at").isNotNull(), "CONFIRMED").otherwise("PENDING")
    latency = F.unix_millis("confirmed_at") - F.unix_millis("first_seen")
    return rows.select("tx_id", status.alias("status"), "first_seen", "confirmed_at", latency.alias("latency_ms"))


def outcome(pairs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Collisions (tx_a, tx_b) with their outcome by the confirmed transactions (tx_id); settled once."""
    c = confirmed.select(F.col("tx_id").alias("_c")).distinct()
    mark = lambda df, s: df.join(c.withColumnRenamed("_c", f"tx_{s}").withColumn(s, F.lit(True)), f"tx_{s}", "left")
    rows = mark(mark(pairs, "a"), "b")
    return rows.withColumn("outcome", F.when(F.col("a"), "TX_A_CONFIRMED").when(F.col("b"), "TX_B_CONFIRMED").otherwise("BOTH_PENDING")).drop("a", "b")
