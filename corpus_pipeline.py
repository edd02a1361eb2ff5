"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Toxic documents go, of near duplicates one stays, documents that hold benchmark passages go, secrets are masked in the
texts that stay, and the texts are packed. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, near_dup, packing, secrets, toxicity
from tidemark.llm.base import WRITTEN, materialise, release, table

#: Rows and bytes at most that go to a Python worker at once. An executor holds a batch on both sides for each of its tasks.
ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_bytes(size: str) -> int:
    return int(size.rstrip("bB"))


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` with the session's batches made smaller where they are larger. Its result is lazy, so that they stay so."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, most in (ROWS, BYTES):
            if not 0 < _in_bytes(spark.conf.get(key)) <= most:
                spark.conf.set(key, most)
        return stage(spark, docs, sf_dir)

    return run


@contextmanager
def own_batches(spark: SparkSession) -> Iterator[None]:
    """Puts the session's sizes of batches back afterwards."""
    was = {key: spark.conf.get(key) for key, _ in (ROWS, BYTES)}
    try:
        yield
    finally:
        for key, size in was.items():
            spark.conf.set(key, size)


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more go. Null and empty texts, null ids and repeated rows are scored as others are."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the least doc_id stays, with every row that repeats it; texts without words and null ids stay."""
    return near_dup.keep_first(docs)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go; null texts have no words and stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; spans of secrets become marks and n_chars follows. Null texts stay null."""
    return secrets.redact(docs)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, null and empty texts' and repeated rows' too."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Models, signatures and a tokenizer take part: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents; what a stage wrote besides its result is deleted once the result is there.
    An empty table gives no pieces; extra columns pass through the stages as they are."""
    docs, first = table(spark, sf_dir, "documents"), len(WRITTEN)
    with own_batches(spark):  # what is left to the caller, the last stage's places, is a few numbers a row
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            release(spark, first, docs.scratch_path)
        return STAGES[-1][1](spark, docs, sf_dir)
