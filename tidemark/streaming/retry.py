"""Transactions whose payload can't be had yet: held back, asked for again, and let through with a mark in the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.functions.payload import parsed

OUT = "network string, tx_hash string, raw_data string, attempts int, evidence string"
UNAVAILABLE = '{"_meta": {"raw_data_unavailable": true}}'
ATTEMPTS, PACE_SECONDS = 3, 30
#: State of this kind is kept by this provider only: set it as spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Recover = Callable[[str, str], str | None]


class Retry(StatefulProcessor):
    """``recover`` (network, tx_hash) is asked when a transaction comes and then each time its timer ends; state is the attempts so far."""

    def __init__(self, recover: Recover, attempts: int, pace: float):
        self.recover, self.attempts, self.pace = recover, attempts, int(pace * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", StructType([StructField("n", IntegerType()), StructField("at", LongType())]))

    def _row(self, key, raw: str | None, n: int, evidence: str | None) -> Row:
        return Row(network=key[0], tx_hash=key[1], raw_data=raw, attempts=n, evidence=evidence)

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.clear()

    def _attempt(self, key, n: int, now: int) -> Iterator[Row]:
        """The ``n``-th attempt: a row where it is the last or succeeds, else a timer."""
        try:
            raw = self.recover(*key)
        except Exception:  # noqa: BLE001  whatever keeps a payload away, it is asked for again
            raw = None
        if raw is not None or n >= self.attempts:
            self._forget()
            yield self._row(key, raw, n, None if raw is not None else UNAVAILABLE)
        else:
            self.state.update((n, now))
            self.handle.registerTimer(now + self.pace)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        whole = next((r["raw_data"] for r in rows if r["whole"]), None)
        if whole is not None:
            self._forget()
            yield self._row(key, whole, 0, None)
        elif not self.state.exists():  # one that waits and comes again isn't counted
            yield from self._attempt(key, 1, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            yield from self._attempt(key, self.state.get()[0] + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def with_payloads(txs: DataFrame, recover: Recover, attempts: int = ATTEMPTS, pace: float = PACE_SECONDS) -> DataFrame:
    """Streaming: OUT for each transaction (network, tx_hash, raw_data, raw_data_truncated).

    A payload that is whole and can be read goes through at once, and so does none at all (null), which there is nothing to recover of. For one that was
    cut off or can't be read, ``recover`` is asked; until it gives the payload the transaction is held back, ``attempts`` times ``pace``
    seconds apart, and then goes through with a null payload and the mark UNAVAILABLE.
    """
    fine = parsed(F.col("raw_data"))["id"].isNotNull() & ~F.coalesce(F.col("raw_data_truncated"), F.lit(False))
    nothing = F.col("raw_data").isNull() & ~F.coalesce(F.col("raw_data_truncated"), F.lit(False))
    rows = txs.select("network", "tx_hash", F.coalesce("raw_data", F.lit("")).alias("raw_data"), F.coalesce(fine | nothing, F.lit(False)).alias("whole"))
    out = rows.groupBy("network", "tx_hash").transformWithState(Retry(recover, attempts, pace), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")
    return out.withColumn("raw_data", F.nullif("raw_data", F.lit("")))
