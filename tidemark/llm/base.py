"""What the operators share: scratch tables, folds, bounded samples and word hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word cache is emptied beyond this many entries, so a worker's memory stays bounded.
CACHE_WORDS = 150_000


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a folder of this process, on a local master only."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_root, "own"):
        shared_root.own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, shared_root.own, ignore_errors=True)
    return f"file://{shared_root.own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop, wherever it lies."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


#: Scratch tables of this process that still exist, in the order in which they were written.
WRITTEN: list[str] = []


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Deletes the scratch tables written after the first ``since``, but for ``keep``: results that read them must have
    been written or used by then."""
    for path in WRITTEN[since:]:
        if path != keep:
            drop_path(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends at files that outlive executors. The
    table stays until ``release`` or ``drop_path``, as results may be read any time."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has the name in any letter case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def utf8(text: Column) -> Column:
    return text.cast("binary")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, bound: int, *more: Column) -> DataFrame:
    """(doc_id, label, text and ``more``) of at most ``bound`` labelled documents of a fold, chosen by a hash of the id.

    Rows with a null id or label are left out; an id labelled twice counts once, with its largest label, and an id
    that several documents bear gives one of their texts. The chosen ids are at most ``bound`` rows, which is the
    size of what is broadcast.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & fold)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return docs.select("doc_id", "text", *more).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])


class WordHash(dict):
    """bytes -> 64-bit hash, remembered for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int, multipliers: np.ndarray) -> np.ndarray:
    """Hash of each run of ``n`` hashed words: an array n - 1 shorter."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:size] * multipliers[0]
        for j in range(1, n):
            h = h + words[j : j + size] * multipliers[j]
    return mixed(h)
