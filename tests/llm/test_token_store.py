import zlib

import numpy as np

from tidemark.llm import token_store as S
from tidemark.llm import tokens


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 63, 64, 5000):
        keys = S.key_hash(np.arange(n) * 7 - 50)
        mph = S.PerfectHash.build(keys)
        assert sorted(mph.slots(keys)) == list(range(n))


def test_index_round_trip_and_absent_keys():
    ids = np.array([5, 5, 9, 12, 12, 12, 40])
    i = S.Index.load(S.Index.build(S.key_hash(ids), np.array([1, 2, 3, 4, 5, 6, 7])).dump())
    assert i.find(S.key_hash(np.array([5, 9, 12, 40])))[0].tolist() == [0, 2, 3, 6]
    first, count = i.find(S.key_hash(np.arange(1000, 21000)))
    assert (first == -1).all() and (count == 0).all()


def brute(rows):
    e, out, start = tokens.Encoder(tokens.tokenizer_path()).tokenizer, [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, t_key(r[1]))):
        ids = e.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def t_key(t):
    return (t is not None, t or "")


def test_store_reads_back_what_was_written(spark):
    rows = [(k * 3 % 101, f"text number {k}\n" * (k % 5)) for k in range(101)] + [(7, "again"), (7, None), (None, "no id"), (200, "long " * 30000), (201, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    got = S.report(d.selectExpr("*", "1 as n_tokens", "2 as shard"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(rows)


def test_lookup_of_some_keys_and_ids(spark, tmp_path):
    rows = [(k, f"doc {k} " * k) for k in range(60)]
    S.write_store(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "s"), shards=5)
    store = S.Store(spark, str(tmp_path / "s"))
    got = store.read(spark.createDataFrame([(3,), (59,), (1000,), (-4,), (None,)], "doc_id long"), with_ids=True).collect()
    e = tokens.Encoder(tokens.tokenizer_path()).tokenizer
    assert {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in got} == {k: e.encode(rows[k][1], add_special_tokens=False).ids + [2] for k in (3, 59)}


def test_empty_table(spark):
    assert S.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
