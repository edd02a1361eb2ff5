"""Tables that jobs write in numbered batches and reads open by day.

A batch is a folder of its own below each day that it has rows of, and writing it again replaces just those folders, when
the write ends; so a batch that failed half-way, or is replayed, neither loses nor doubles a row. The day of a row must follow from its
key (a transaction's own day, say): then all versions of a key are of one day, and a filter on days may come before newest rows are
taken. Files hold a bloom filter of the keys, so that a read of one key opens few of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.versions import latest_by_key
from tidemark.schema import CLASSES

SCORES = "network string, tx_hash string, " + ", ".join(f"{c} double" for c in CLASSES) + (
    ", max_score double, max_class string, risk_band string, corroboration_count int, corroborating_classes string, evidence string, analyzed_at timestamp"
)
BASELINES = "network string, scope_type string, scope_id string, feature string, p50 double, p99 double, sample_count long, computed_at timestamp"
DRIFTS = "network string, scope_type string, scope_id string, feature string, axis string, old_value double, new_value double, drift_ratio double, applied boolean, detected_at timestamp"
CURSOR = "network string, mark timestamp, rescanned_at timestamp, last_batch long"


@dataclass(frozen=True)
class Stored:
    """Columns of a table (all that rows have, where None), its key and the column whose largest value is the newest row's."""

    columns: str | None
    key: tuple[str, ...]
    version: str | None


TABLES = {
    "tx_class_scores": Stored(SCORES, ("network", "tx_hash"), "analyzed_at"),
    "baselines": Stored(BASELINES, ("network", "scope_type", "scope_id", "feature"), "computed_at"),
    "baseline_drift_events": Stored(DRIFTS, ("network", "scope_type", "scope_id", "feature", "axis", "detected_at"), None),
    "poll_cursor": Stored(CURSOR, ("network",), "last_batch"),
}
#: What stands for the day of tables that aren't read by day.
NO_DAY = "1970-01-01"


class Store:
    """Tables below ``root``, a path that all executors share."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Stored] | None = None):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), TABLES | (tables or {})

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _files(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def exists(self, table: str) -> bool:
        files, path = self._files(self.path(table))
        return files.exists(path)

    def days(self, table: str) -> dict[str, list[int]]:
        """The batches of each day that the table has, by the names of its folders."""
        out: dict[str, list[int]] = {}
        if self.exists(table):
            files, path = self._files(self.path(table))
            for day in files.listStatus(path):
                if (name := day.getPath().getName()).startswith("day="):
                    out[name[4:]] = sorted(int(b.getPath().getName()[6:]) for b in files.listStatus(day.getPath()) if b.getPath().getName().startswith("batch="))
        return out

    def put(self, table: str, rows: DataFrame, batch: int, day: Column | None = None) -> None:
        """Writes ``rows`` as batch number ``batch``. Columns that are missing are null; those that the table has not are left out."""
        spec = self.tables[table]
        if spec.columns:
            want = self.spark.createDataFrame([], spec.columns).schema
            rows = rows.withColumn("_day", F.lit(None) if day is None else day)
            have = set(rows.columns)
            rows = rows.select("_day", *[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])
        else:
            rows = rows.withColumn("_day", F.lit(None) if day is None else day)
        rows = rows.withColumn("day", F.coalesce(F.col("_day").cast("date"), F.to_date(F.lit(NO_DAY)))).drop("_day").withColumn("batch", F.lit(batch).cast("long"))
        # as many tasks as a day needs, and no more files than that
        self._write(table, rows.hint("rebalance", "day"))

    def _write(self, table: str, rows: DataFrame) -> None:
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch")
        for c in self.tables[table].key:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(self.path(table))

    def rows(self, table: str, since: str | None = None, until: str | None = None) -> DataFrame:
        """All versions of the rows of the days from ``since`` to ``until`` (both included), with ``batch`` and ``day``; other days' files
        aren't opened. A table that nothing was written to has no rows, if its columns are known."""
        spec = self.tables[table]
        reader = self.spark.read
        if spec.columns:
            if not self.exists(table):
                return self.spark.createDataFrame([], f"{spec.columns}, day date, batch long")
            reader = reader.schema(f"{spec.columns}, day date, batch long")
        out = reader.parquet(self.path(table))
        if since is not None:
            out = out.filter(F.col("day") >= F.lit(since).cast("date"))
        return out if until is None else out.filter(F.col("day") <= F.lit(until).cast("date"))

    def read(self, table: str, since: str | None = None, until: str | None = None) -> DataFrame:
        """The newest row of each key, of equal versions the one of the later batch."""
        spec, rows = self.tables[table], self.rows(table, since, until)
        return (rows if spec.version is None else latest_by_key(rows, spec.key, spec.version, ["batch"])).drop("batch", "day")

    def prune(self, table: str, before: str, capped: bool = False) -> list[str]:
        """Deletes the folders of the days before ``before`` and returns them. Nothing is read or rewritten. Refused while payloads are
        capped, as what was cut off is then in those folders alone."""
        if capped:
            raise ValueError("days can't be pruned while payloads are capped")
        gone = sorted(d for d in self.days(table) if NO_DAY < d < before)
        for day in gone:
            files, path = self._files(f"{self.path(table)}/day={day}")
            files.delete(path, True)
        return gone

    def compact(self, table: str, tombstones: DataFrame | None = None, batches: int = 16) -> list[str]:
        """Merges the batches of each day that has more than ``batches`` of them, or a row of a key that ``tombstones`` has, to one folder
        with the newest rows of keys without a tombstone; returns the days. Other days' files stay as they are.

        The merged rows are written as the day's last batch, which exists before and is replaced when the write ends, and the
        earlier folders go afterwards. Where the job is lost in between, they hold the same rows or older versions of them, and keys that
        tombstones took away; running it again ends it. Newest rows are the same all along, but for keys with a tombstone.
        """
        spec, found = self.tables[table], self.days(table)
        touched = {d for d, b in found.items() if len(b) > batches}
        if tombstones is not None and found:
            keys = tombstones.select(*spec.key).distinct()
            hit = self.rows(table).join(keys, list(spec.key), "left_semi").select("day").distinct()
            touched |= {str(r["day"]) for r in hit.collect()}
        for day in sorted(touched):
            last = found[day][-1]
            rows = self.rows(table, day, day)
            rows = rows if spec.version is None else latest_by_key(rows, spec.key, spec.version, ["batch"])
            if tombstones is not None:
                rows = rows.join(keys, list(spec.key), "left_anti")
            # the files to be replaced are read until the write ends, so the merged rows go beside them first
            staged = f"{self.root}/_{table}-{day}"
            rows.drop("batch", "day").write.mode("overwrite").parquet(staged)
            merged = self.spark.read.parquet(staged).withColumn("day", F.lit(day).cast("date")).withColumn("batch", F.lit(last).cast("long"))
            some = merged.limit(1).count() > 0
            if some:
                self._write(table, merged.hint("rebalance", "day"))
            whole = f"{self.path(table)}/day={day}"
            for folder in [*([f"{whole}/batch={b}" for b in found[day][:-1]] if some else [whole]), staged]:
                files, path = self._files(folder)
                files.delete(path, True)
        return sorted(touched)


def put_scores(store: Store, scores: DataFrame, batch: int, now: Column, day: Column) -> None:
    """The rows that ``plans.scorers.together`` gives, as a batch of scores: a class without a score is -1. ``day`` is the
    transaction's."""
    have = set(scores.columns)
    filled = {c: F.coalesce(F.col(c), F.lit(-1.0)) if c in have else F.lit(-1.0) for c in CLASSES}
    store.put("tx_class_scores", scores.withColumns(filled | {"analyzed_at": now}), batch, day)

