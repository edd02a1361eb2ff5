"""Token shards with a minimal perfect hash index.

A store is a folder of shards in ascending key order. A shard is two files and a row of the manifest:

``*.ids``   the ids of its documents one after another, raw little-endian unsigned 16-bit integers;
``*.mph``   the index: an int64 header (magic, keys, records, levels, words), the levels' sizes, the levels' bits as 64-bit
            words with the number of bits before each word, then by slot a 32-bit fingerprint, first record and number of
            records, and by record its offset in ids (one more at the end).

A key is looked up in constant time: each level of the index hashes it to one bit; the first level whose bit is set gives
the slot, which is the count of bits before it; the stored fingerprint tells keys that were never put in (wrong for one
in 2^32 of them). Keys that repeat share a slot and have consecutive records.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import mixed, scratch
from tidemark.llm.tokens import encoder, tokenizer_path

MAGIC = 0x31_48_50_4D_44_49_54
SEEDS = np.random.default_rng(2).integers(0, 2**63, 64, dtype=np.uint64)
FINGERPRINT = np.uint64(0x5BD1E9955BD1E995)
#: What a null key hashes to.
NULL_KEY = np.uint64(0x6E756C6C)
SHARD_BYTES = 128 << 20
READ_BYTES = 4 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def key_hash(ids: np.ndarray, null: np.ndarray | None = None) -> np.ndarray:
    h = mixed(ids.astype(np.int64).view(np.uint64))
    return h if null is None else np.where(null, NULL_KEY, h)


class PerfectHash:
    """Slots 0 to n - 1 for n different 64-bit keys, in about 3 bits a key."""

    GAMMA = 2

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(words) else np.zeros(0, np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` differ from each other."""
        sizes, parts = [], []
        for seed in SEEDS:
            if not len(keys):
                break
            m = -(-max(64, cls.GAMMA * len(keys)) // 64) * 64
            at = (mixed(keys ^ seed) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(m)
            keys = keys[~alone[at]]
        if len(keys):
            raise ValueError("two keys are equal")
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; a key that was never put in gets any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, m in enumerate(self.sizes.tolist()):
            bit = self.bases[k] + (mixed(keys[left] ^ SEEDS[k]) % np.uint64(m)).astype(np.int64)
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            there = (word >> shift) & np.uint64(1) == 1
            low = word[there] & ((np.uint64(1) << shift[there]) - np.uint64(1))
            out[left[there]] = self.before[bit[there] >> 6] + np.bitwise_count(low)
            left = left[~there]
        return out


class Index:
    """A shard's index in memory."""

    def __init__(self, mph: PerfectHash, marks: np.ndarray, first: np.ndarray, count: np.ndarray, offsets: np.ndarray):
        self.mph, self.marks, self.first, self.count, self.offsets = mph, marks, first, count, offsets

    @classmethod
    def build(cls, keys: np.ndarray, lengths: np.ndarray) -> Index:
        """keys: a hash for each record, equal ones side by side; lengths: ids of each record."""
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        unique = keys[starts]
        mph = PerfectHash.build(unique)
        slot = mph.slots(unique)
        n = len(unique)
        marks, first, count = (np.zeros(n, np.uint32) for _ in range(3))
        marks[slot] = cls.mark(unique)
        first[slot] = starts
        count[slot] = np.diff(np.concatenate([starts, [len(keys)]]))
        return cls(mph, marks, first, count, np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64))

    @staticmethod
    def mark(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys ^ FINGERPRINT) >> np.uint64(32)).astype(np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; -1 and 0 for a key that isn't there."""
        if not len(self.marks):
            return np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        slot = self.mph.slots(keys)
        there = (slot >= 0) & (self.marks[slot] == self.mark(keys))
        return np.where(there, self.first[slot].astype(np.int64), -1), np.where(there, self.count[slot].astype(np.int64), 0)

    def dump(self) -> bytes:
        m = self.mph
        head = np.array([MAGIC, len(self.marks), len(self.offsets) - 1, len(m.sizes), len(m.words)], "<i8")
        return b"".join(
            x.tobytes()
            for x in (head, m.sizes.astype("<i8"), m.words.astype("<u8"), m.before.astype("<i8"), self.marks.astype("<u4"), self.first.astype("<u4"), self.count.astype("<u4"), self.offsets.astype("<u8"))
        )

    @classmethod
    def load(cls, data: bytes) -> Index:
        magic, n, records, levels, words = np.frombuffer(data, "<i8", 5).tolist()
        if magic != MAGIC:
            raise ValueError("not an index")
        at = 40

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, k, at)
            at += out.nbytes
            return out

        mph = PerfectHash(take("<i8", levels), take("<u8", words))
        take("<i8", words)
        return cls(mph, take("<u4", n), take("<u4", n), take("<u4", n), take("<u8", records + 1))


MANIFEST = "shard string, part int, low long, high long, holds_null boolean, n_docs long, n_tokens long"


def _writer(path: str, tokenizer: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode_all
        fs, root = file_system(path)
        name = uuid.uuid4().hex  # a task that runs twice leaves a file that no manifest names
        end = b"" if end_id is None else np.array([end_id], "<u2").tobytes()
        out, ids, null, lengths = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.ids")
            key = batch.column(0)
            null.append(key.is_null().to_numpy(zero_copy_only=False))
            ids.append(key.fill_null(0).to_numpy())
            for got in encode(t.as_py() or "" for t in batch.column(1)):
                out.write(got + end)
                lengths.append(len(got + end) // 2)
        if out is None:
            return
        out.close()
        keys, null = np.concatenate(ids), np.concatenate(null)
        with fs.open_output_stream(f"{root}/{name}.mph") as f:
            f.write(Index.build(key_hash(keys, null), np.array(lengths)).dump())
        real = keys[~null]
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "shard": name, "part": TaskContext.get().partitionId(), "low": int(real[0]) if len(real) else None, "high": int(real[-1]) if len(real) else None,
                    "holds_null": bool(null.any()), "n_docs": len(keys), "n_tokens": int(sum(lengths)),
                }
            ],
            pa.schema([("shard", pa.string()), ("part", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("holds_null", pa.bool_()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    return write


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 2, shards: int | None = None) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to a store at ``path``, a shared folder.

    Documents are dealt to shards by ranges of doc_id and sorted there; all documents of one id are in one shard, in the
    order of their texts. A null id comes first, a null text is an empty one, which has the end id alone. No documents
    give a store without shards. ``shards`` is the number aimed at; as given by Spark's shuffle setting, or more for
    inputs over SHARD_BYTES a shard.
    """
    spark = docs.sparkSession
    if shards is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, size // SHARD_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_writer(path, tokenizer or tokenizer_path(), end_id), MANIFEST).write.parquet(f"{path}/manifest")


class Store:
    """A written store. Its manifest, a row for each shard, is held by the driver."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.col("low").asc_nulls_first(), "part").collect()
        starts = np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])]).tolist()
        self.shards = [r.shard for r in rows]
        self.starts = starts[:-1]
        self.n_tokens = starts[-1]
        self.null_in = next((k for k, r in enumerate(rows) if r.holds_null), -1)
        self.lows = [(-(2**63) if r.low is None else r.low) for r in rows]

    def read(self, keys: DataFrame, with_ids: bool = False) -> DataFrame:
        """A row for each row of ``keys`` (doc_id) that the store holds: doc_id, start, n_tokens, ids_crc32 [, ids].

        start is the number of ids before the document in the whole store. Keys are sent to their shards; there each is
        looked up in the index and its ids are read by range, neighbours in one read. The k-th row of a repeated key gets
        the k-th of its documents, or none beyond the last.
        """
        lows, null_in = np.array(self.lows, np.int64), self.null_in
        shards, starts, path = self.shards, self.starts, self.path

        @F.arrow_udf("int")
        def shard_of(ids: pa.Array) -> pa.Array:
            at = np.searchsorted(lows, ids.fill_null(0).to_numpy(), side="right") - 1
            return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), null_in, at), pa.int32())

        def look(group: pd.DataFrame) -> pd.DataFrame:
            k = int(group["shard"].iloc[0])
            fs, root = file_system(path)
            with fs.open_input_file(f"{root}/{shards[k]}.mph") as f:
                index = Index.load(f.read())
            null = group["doc_id"].isna().to_numpy()
            ids = group["doc_id"].fillna(0).to_numpy().astype(np.int64)
            first, count = index.find(key_hash(ids, null))
            nth = group.groupby("doc_id", dropna=False).cumcount().to_numpy()
            there = np.flatnonzero(nth < count)
            record = (first + nth)[there]
            order = np.argsort(record, kind="stable")
            there, record = there[order], record[order]
            begin, end = index.offsets[record].astype(np.int64), index.offsets[record + 1].astype(np.int64)
            sums, raw = [], []
            with fs.open_input_file(f"{root}/{shards[k]}.ids") as f:
                a = 0
                while a < len(record):
                    b = a + 1
                    while b < len(record) and begin[b] == end[b - 1] and 2 * (end[b] - begin[a]) <= READ_BYTES:
                        b += 1
                    data = np.frombuffer(f.read_at(2 * int(end[b - 1] - begin[a]), 2 * int(begin[a])), "<u2")
                    for j in range(a, b):
                        own = data[begin[j] - begin[a] : end[j] - begin[a]]
                        sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                        if with_ids:
                            raw.append(own.tobytes())
                    a = b
            out = pd.DataFrame({"doc_id": group["doc_id"].iloc[there].to_numpy(), "start": begin + starts[k], "n_tokens": end - begin, "ids_crc32": np.array(sums, np.int64)})
            out["doc_id"] = pd.array(np.where(null[there], 0, ids[there]), "Int64")
            out.loc[null[there], "doc_id"] = pd.NA
            if with_ids:
                out["ids"] = raw
            return out

        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
        if not shards:
            return self.spark.createDataFrame([], schema)
        keyed = keys.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("shard", shard_of("doc_id"))
        return keyed.filter("shard >= 0").groupBy("shard").applyInPandas(look, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from a store written to the shared folder."""
    path = scratch(docs.sparkSession, "tokens")
    write_store(docs, path)
    return Store(docs.sparkSession, path).read(docs.select("doc_id"))
