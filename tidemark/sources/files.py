"""File sources and sinks: raw payloads, archives as CSV, reports, and a paged source for services that list by cursor."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.scoring import csv_safe
from tidemark.operators.joins import with_marker
from tidemark.operators.versions import new_rows


def write_raw(df: DataFrame, root: str) -> None:
    """Payloads (network, tx_hash, day, raw_data) as gzip JSON by network, day and the first two digits of the hash."""
    rows = df.withColumn("shard", F.substring("tx_hash", 1, 2))
    rows.write.mode("append").partitionBy("network", "day", "shard").option("compression", "gzip").json(root)


def read_raw(spark: SparkSession, root: str, network: str | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """Payloads again; a network prunes folders, hashes prune rows. Written twice counts once."""
    df = spark.read.schema("tx_hash string, raw_data string, network string, day string, shard string").json(root)
    if network is not None:
        df = df.filter(F.col("network") == network)
    if hashes is not None:
        df = df.join(hashes.select("tx_hash").distinct(), "tx_hash", "left_semi")
    return df.dropDuplicates(["network", "tx_hash"])


def export_csv(df: DataFrame, path: str) -> None:
    """CSV that spreadsheets take for text only."""
    safe = [csv_safe(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", True).csv(path)


def import_csv(spark: SparkSession, path: str, schema: str, existing: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to insert, and a row of counts (inserted, skipped): keys that are there already, or twice in the file, are skipped."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    fresh = new_rows(rows, existing, key)
    marked = with_marker(rows.select(*key), existing, key, "there")
    total = marked.agg(F.count(F.lit(1)).alias("n")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("inserted")))
    return fresh, total.select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))


def slot_time(slot: Column, eras: list[tuple[int, int, int, int]]) -> Column:
    """UTC time of a slot by a table of eras (first slot, end slot, unix time of the first, seconds a slot); null beyond."""
    out = F
    for first, end, unix, seconds in eras:
        out = out.when((slot >= first) & (slot < end), F.timestamp_seconds(F.lit(unix) + (slot - first) * seconds))
    return out.otherwise(F.lit(None))


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class _Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.pages, self.tries = options["url"], int(options.get("pages", 1)), int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        return [_Page(k) for k in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import time

        for k in range(self.tries):
            try:
                with urllib.request.urlopen(self.url.format(page=partition.value), timeout=30) as r:
                    for item in json.loads(r.read()):
                        yield (partition.value, json.dumps(item))
                return
            except OSError:
                if k + 1 == self.tries:
                    raise
                time.sleep(2**k)


class PagedSource(DataSource):
    """Batch source of JSON pages: options ``url`` with ``{page}``, ``pages`` and ``tries``; a page is a partition.

    Register with ``spark.dataSource.register(PagedSource)``, read as format ``json_pages``.
    """

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "page int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)
