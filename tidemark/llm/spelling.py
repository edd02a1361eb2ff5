"""Spelling variants by a symmetric-delete join.

Every word of the vocabulary emits itself and its distinct single deletions, as hashed keys beside the places whose deletion gives them.
Keys are joined; two words of a key are one code point apart if one is the key itself (an insertion) or if both give it by
deleting at the same place (a replacement), and each such pair meets at one key only. Whole words then decide, so that
hashes never do. The most frequent near word may be a word's form, and forms are followed to their roots by jumps.

Words are distinct, so a key of L code points is met by at most 1 + 90 (L + 1) words, 90 being the letters there are: no key is hot
however the texts are. Keys cost eight bytes a deletion however long the word. Counts are merged before they are dealt.

Results for odd rows: null texts have no words; a null id counts as empty text in the hash; repeated rows count each. A text without
words, or no documents, gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import drop_path, materialise, mixed, odd_numbers

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as its variant.
TIMES = 10
#: One in so many distinct words of a document loses a code point.
DROP_ONE_IN = 31
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE, _LENGTH = map(int, odd_numbers(2, 12))
_INVERSE = pow(_BASE, -1, 2**64)

KEYS = "id long, key long, first int, last int"


def cut(word: Column, place: Column) -> Column:
    """``word`` without the code point at ``place`` (from 0); the word itself where that is negative."""
    return F.when(place < 0, word).otherwise(F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word))))


def words(docs: DataFrame) -> DataFrame:
    """word, n: the vocabulary (LEAST_LENGTH code points, LEAST_COUNT occurrences at least)."""
    # shorter runs can't give a word, as letters are only taken away
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("head"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("head", "run").cast("binary"))
    rows = rows.select("run", h.alias("h")).select(cut(F.col("run"), F.when(F.col("h") % DROP_ONE_IN == 0, (F.col("h") % F.length("run")).cast("int")).otherwise(-1)).alias("word"))
    return rows.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def deletion_keys(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, first and last place: of the word itself (places -1), then of each distinct deletion."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    with np.errstate(over="ignore"):
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(codes + np.uint64(1)) * power[:n], dtype=np.uint64)])
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if n else np.zeros(0, np.int64)
        last = np.append(first[1:], n)[: len(first)] - 1
        gone = sums[first] + (sums[n] - sums[first + 1]) * np.uint64(_INVERSE) if n else np.zeros(0, np.uint64)
        keys = mixed(np.concatenate([[sums[n] + np.uint64(n * _LENGTH % 2**64)], gone + np.uint64((n - 1) * _LENGTH % 2**64)]))
    return keys.view(np.int64), np.concatenate([[-1], first]), np.concatenate([[-1], last])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            ids, every = part.column(0).to_numpy(), [deletion_keys(w) for w in part.column(1).to_pylist()]
            keys, first, last = (np.concatenate([x[k] for x in every]) for k in range(3))
            owner = np.repeat(ids, [len(x[0]) for x in every])
            yield pa.RecordBatch.from_pydict({"id": pa.array(owner, pa.int64()), "key": pa.array(keys), "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32())})


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """id, near_word, near_n for each two words (id, word, n) one code point apart, from either side."""
    keys = materialise(vocabulary.select("id", "word").mapInArrow(_emit, KEYS), "deletions")
    side = lambda s: keys.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "first", "last")])
    place = F.greatest("first_a", "first_b")
    inserted = (F.col("first_a") < 0) != (F.col("first_b") < 0)
    replaced = (F.col("first_a") >= 0) & (F.col("first_b") >= 0) & (place <= F.least("last_a", "last_b"))
    met = side("a").join(side("b"), "key").filter((F.col("id_a") != F.col("id_b")) & (inserted | replaced))
    met = met.select("id_a", "id_b", F.when(F.col("first_a") < 0, -1).otherwise(place).alias("at_a"), F.when(F.col("first_b") < 0, -1).otherwise(place).alias("at_b"))
    own = lambda s: vocabulary.select(F.col("id").alias(f"id_{s}"), F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}"))
    both = met.join(own("b"), "id_b").join(own("a"), "id_a")
    both = both.filter((F.col("word_a") != F.col("word_b")) & (cut(F.col("word_a"), F.col("at_a")) == cut(F.col("word_b"), F.col("at_b"))))
    return both.select(F.col("id_a").alias("id"), F.col("word_b").alias("near_word"), F.col("n_b").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form (word, form): jumps along forms double in length, so a chain of d forms takes
    log2(d) of them. Forms are ten times as frequent, so that chains end."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        new = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        drop_path(forms.sparkSession, now.scratch_path)
        now = new.select("word", "root")
        now.scratch_path = new.scratch_path
        if not new.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of the vocabulary of documents (doc_id, text)."""
    vocabulary = materialise(words(docs).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("word")))
    near = near_pairs(vocabulary).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = vocabulary.join(near, "id", "left")
    often = -F.col("best.less") >= TIMES * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    rows = materialise(rows, "forms")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
