from tests.llm import test_secrets as base
from tidemark.llm import secrets as S

KEY = "x8Kq2LmZ7vRt4WbN9cYp3HdF6"
#: Text before a value; none of the names is one of the base list.
LEADS = ("PRIVATE_KEY=", "auth=", "see https://h.org/a?sig=", "?a=1&credential=", "x==", "AWS_S3_UPLOAD_BUCKET_KEY_2=", "k = ", "KEY: ")


def docs(spark, texts):
    return spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")


def test_values_after_an_equals_sign(spark):
    d = docs(spark, [f"{a}{KEY} end" for a in LEADS])
    for r in S.report(d).collect():
        at = len(LEADS[r.doc_id])
        assert f"entropy:{at}:{at + len(KEY)}" in r.spans.split(","), LEADS[r.doc_id]
    assert all(KEY not in r.text and S.REDACTED in r.text and r.n_chars == len(r.text) for r in S.redact(d).collect())


def test_base_names_and_plain_values_as_before(spark):
    texts = [f"token={KEY}", "path=wp_content/uploads_of/pictures2024", "id=123e4567-e89b-42d3-a456-426614174000", "q=EXAMPLEx8Kq2LmZ7vRt4WbN9cYp"]
    got = {r.doc_id: r.spans for r in S.report(docs(spark, texts)).collect()}
    assert got == {0: base.brute(texts[0])[4] + ",entropy:6:31", 1: "", 2: "", 3: ""}
