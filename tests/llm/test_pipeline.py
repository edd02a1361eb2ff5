import pyarrow as pa
import pytest

import corpus_pipeline as C
from tests.llm import test_decontaminate as bench
from tests.llm import test_near_dup as near
from tests.llm import test_secrets as secret
from tidemark.llm import near_dup, packing, tokens, toxicity

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_version(spark):
    docs = C.table(spark, SF, "documents")
    labels, benchmark = C.table(spark, SF, "labels"), [(r.item_id, r.text) for r in C.table(spark, SF, "benchmark").collect()]
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs.collect()
        out = C.materialise(stage(spark, docs, SF), "test")
        after = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if name == "toxicity":
            scores, s = toxicity.annotate(docs, toxicity.train(docs, labels, toxicity.training_fold(C.toxicity.F.col("doc_id"))))
            assert {r.doc_id for r in after} == {r.doc_id for r in scores.collect() if r[s] < 0.5}
        elif name == "near duplicates":
            assert {r.doc_id for r in after} == {x[0] for x in near.brute([(r.doc_id, r.text) for r in before], 80) if x[3]}
        elif name == "decontamination":
            assert {r.doc_id for r in after} == {x[0] for x in bench.brute([(r.doc_id, r.text) for r in before], benchmark) if not x[5]}
        elif name == "secrets":
            was = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            assert all((r.text == was[r.doc_id]) or r.n_chars == len(r.text) for r in after)
            assert all(r.text != was[r.doc_id] for r in after if secret.brute(was[r.doc_id])[4])
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before} and max(r.offset + r.length for r in after) <= 2048
        docs = out
    assert C.run(spark, SF).count() == docs.count()


def test_odd_rows_go_through_the_chain(spark, tmp_path):
    """Null and empty texts, null ids, repeated rows and extra columns with the names that stages use."""
    for name in ("labels", "benchmark"):
        C.table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = C.table(spark, SF, "documents")
    first = docs.filter("length(text) > 200").orderBy("doc_id").first()
    odd = [(90_001, None), (90_002, ""), (90_003, " \n "), (None, "a text without an id that nothing else resembles"), (90_004, "see " + "a/" * 20_000 + "Zq9x8k7"), (90_005, "the very same row"), (90_005, "the very same row"), (90_006, "token=abcdefghij0123")]
    rows = docs.unionByName(spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long").select([C.toxicity.F.col(c).cast(k) for c, k in docs.dtypes]))
    extra = {c: C.toxicity.F.lit(7) for c in ("key", "id", "t", "score", "_gone", "_spans", "_cut", "component_id")}
    rows.withColumns(extra).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = C.run(spark, str(tmp_path)).collect()
    own = {}
    for p in pieces:
        own.setdefault(p.doc_id, []).append(p)
    assert {90_001, 90_002, 90_003, None, 90_004, 90_005, 90_006} <= set(own) and first.doc_id is not None
    assert [p.length for p in own[90_001]] == [1] and len(own[90_005]) == 2
    assert max(p.offset + p.length for p in pieces) <= 2048
    rows.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        C.table(spark, SF, name).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("stage", [f for name, f in C.STAGES if name != "secrets"])
def test_stages_hand_small_batches_to_python(spark, stage, monkeypatch):
    """By rows and by bytes; a size that is smaller already stays."""
    for module, name in ((C.toxicity, "reject"), (C.near_dup, "keep_first"), (C.decontaminate, "decontaminate"), (C.packing, "pack")):
        monkeypatch.setattr(module, name, lambda docs, *_: docs)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows]), "size": pa.array([b.nbytes])})

    docs = C.table(spark, SF, "documents")
    few = spark.range(0, 5_000, 1, 1)
    long = few.limit(400).selectExpr("repeat('x', 100000) s")
    with C.own_batches(spark):
        spark.conf.set(C.ROWS[0], 10_000)
        spark.conf.set(C.BYTES[0], 1 << 26)
        stage(spark, docs, SF)
        met = few.mapInArrow(sizes, "n long, size long").collect()
        assert max(r.n for r in met) <= 1000 and sum(r.n for r in met) == 5_000
        met = long.mapInArrow(sizes, "n long, size long").collect()
        assert max(r.size for r in met) < 10 << 20 and sum(r.n for r in met) == 400
        spark.conf.set(C.ROWS[0], 70)
        stage(spark, docs, SF)
        assert max(r.n for r in few.mapInArrow(sizes, "n long, size long").collect()) == 70


def test_sizes_of_batches_are_put_back(spark):
    was = [spark.conf.get(key) for key, _ in (C.ROWS, C.BYTES)]
    C.run(spark, SF)
    assert [spark.conf.get(key) for key, _ in (C.ROWS, C.BYTES)] == was


def test_a_worker_lets_go_of_the_encoder():
    """What packing remembers of a corpus doesn't stay in a worker that goes on to another stage."""
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array([b"a few words of a text"])})
    terms = pa.RecordBatch.from_pydict({"half": pa.array([0]), "y": pa.array([1]), "text": docs.column(1)})
    for work, batch in ((near_dup._sign, docs), (toxicity._terms, terms)):
        tokens.encoder(packing.tokenizer_path()).encode("some more words")
        assert tokens.encoder.cache_info().currsize == 1
        assert sum(b.num_rows for b in work(iter([batch]))) > 0
        assert tokens.encoder.cache_info().currsize == 0
