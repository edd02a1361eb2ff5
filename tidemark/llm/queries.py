"""The queries that apply the operators to the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, group_join, hard_negatives, language, near_dup, packing, quality_fm, quality_rules, secrets, spelling, token_store, toxicity, warc_zip
from tidemark.llm.base import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.report(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.report(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op11_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.classes(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
      WHERE item_id IS NOT NULL),
bn AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n)),
met AS (SELECT DISTINCT doc_id, i, dw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM met)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
        FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN k x ON x.doc_id = a JOIN k y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, b AS met FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.met)
SELECT w.doc_id, coalesce(k.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.c, w.doc_id)) AS kept
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, min(met) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT page_id, h, hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (j // 4) + 1, 5))::INT >> (15 - 5 * (j % 4))) & 31)::INT + 1, 1)
                        FOR j IN range(32)], '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""

# as op4's, with shingles of four words
OP11_SQL = f"SELECT doc_id, n_shingles, component_id FROM ({OP4_SQL.replace('least(5, ', 'least(4, ')})"

# crc32 by its table of 256 remainders, over the bytes that hex() shows
OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h FROM per, crc),
named AS (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM named WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT DISTINCT a.word AS a, v.word AS b FROM cuts a JOIN v ON a.rest = v.word),
near AS (SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION ALL SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-v.n, b)) AS b, max(v.n) AS bn FROM near JOIN v ON v.word = near.b GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 10 * v.n THEN b END AS form, CASE WHEN bn >= 10 * v.n THEN bn END AS form_n
      FROM v LEFT JOIN best ON best.a = v.word),
r AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL),
last AS (SELECT r.word, r.at FROM r JOIN f ON f.word = r.at WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, coalesce(last.at, f.word) AS root FROM f LEFT JOIN last ON last.word = f.word
"""

OP13_SQL = """
WITH r AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS ak, a.vec_id AS anchor_id, a.y AS ay, b.k AS bk, b.vec_id, b.y,
             coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
      FROM r a JOIN r b ON a.k <> b.k WHERE a.vec_id % 50 = 0),
p AS (SELECT ak, ay, anchor_id, bk AS pk, vec_id AS positive_id, score AS positive_score FROM s WHERE y = ay
      QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.ak, pk ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.ak = p.ak AND s.y <> p.ay AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_store": op2_token_store,
    "op3_quality": op3_quality,
    "op4_near_dup": op4_near_dup,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_warc_zip": op7_warc_zip,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_language": op10_language,
    "op11_group_join": op11_group_join,
    "op12_spelling": op12_spelling,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op4_near_dup": OP4_SQL,
    "op7_warc_zip": OP7_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_group_join": OP11_SQL,
    "op12_spelling": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
