"""Scoring what no score is there for yet, a batch at a time, with a cursor that moves once the scores are written.

A poll looks at transactions that were written since the cursor, which lies ``overlap`` seconds behind the newest one scored, and
leaves out those with a score. Every ``rescan`` seconds it looks at all of them, so that whatever was deferred or written late comes in.
Scores and cursor are batches of a store: if scoring or writing fails, the cursor still has the last batch's number, and the next
poll writes the same batch again, in place of what there is of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.reads import unprocessed
from tidemark.sources.store import Store, put_scores

KEY = ["network", "tx_hash"]


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class Poll:
    """``transactions`` gives the newest rows of transactions (network, tx_hash, ingestion_timestamp, timestamp, ...), ``analyse``
    the rows of class scores of some of them; those that it leaves out stay for a later poll."""

    store: Store
    network: str
    transactions: Callable[[], DataFrame]
    analyse: Callable[[DataFrame], DataFrame]
    batch: int = 500
    overlap: int = 120
    rescan: int = 600
    clock: Callable[[], datetime] = utc_now

    def cursor(self) -> tuple[datetime | None, datetime | None, int]:
        """From where to look, when all was looked at last, and the number of the last batch."""
        row = self.store.read("poll_cursor").filter(F.col("network") == self.network).first()
        return (row["mark"], row["rescanned_at"], row["last_batch"]) if row else (None, None, -1)

    def step(self) -> int:
        """Scores a batch; how many transactions were looked at. Fewer than ``batch``: nothing is left."""
        mark, rescanned, last = self.cursor()
        now = self.clock().astimezone(timezone.utc)
        full = rescanned is None or now - rescanned.astimezone(timezone.utc) >= timedelta(seconds=self.rescan)
        rows = self.transactions().filter(F.col("network") == self.network)
        if mark is not None and not full:
            rows = rows.filter(F.col("ingestion_timestamp") >= F.lit(mark))
        # scores of a batch that the cursor doesn't know are of a poll that failed, and are replaced
        scored = self.store.rows("tx_class_scores").filter(F.col("batch") <= last)
        todo = unprocessed(rows, [scored], KEY).orderBy("ingestion_timestamp", "tx_hash").limit(self.batch).persist()
        try:
            seen = todo.agg(F.count(F.lit(1)).alias("n"), (F.max("ingestion_timestamp") - F.make_dt_interval(secs=F.lit(self.overlap))).alias("mark")).first()
            number = last + 1
            if seen["n"]:
                scored = self.analyse(todo).join(todo.select(*KEY, F.to_date("timestamp").alias("_of")), KEY)
                put_scores(self.store, scored, number, F.lit(now), F.col("_of"))
        finally:
            todo.unpersist()
        # a full look that filled its batch hasn't seen all
        ended = seen["n"] < self.batch
        if seen["n"] or full:
            moved = max(filter(None, [mark, seen["mark"]]), default=None)
            at = now if full and ended else rescanned
            row = self.store.spark.createDataFrame([(self.network, moved, at, number)], "network string, mark timestamp, rescanned_at timestamp, last_batch long")
            self.store.put("poll_cursor", row, number)
        return seen["n"]

    def drain(self, batches: int = 20) -> int:
        """Batches until one isn't full, ``batches`` at most; how many transactions were looked at."""
        total = 0
        for _ in range(batches):
            n = self.step()
            total += n
            if n < self.batch:
                break
        return total


def drain_stream(spark: SparkSession, source: DataFrame, store: Store, analyse: Callable[[DataFrame], DataFrame], checkpoint: str, now=F.current_timestamp) -> None:
    """Scores all that has come to a stream of transactions since the last call, and ends. A batch's place in the stream is noted once its
    scores are written, and a batch that failed comes again under its number, which replaces what it wrote."""

    def step(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            scored = analyse(rows).join(rows.select(*KEY, F.to_date("timestamp").alias("_of")).dropDuplicates(KEY), KEY)
            put_scores(store, scored, number, now(), F.col("_of"))
        finally:
            rows.unpersist()

    query = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
