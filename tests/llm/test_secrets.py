import hashlib
import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import secrets as S

KINDS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def brute(text):
    spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))
    joined = ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans)
    c = Counter(k for _, k, _ in spans)
    return c[0], c[1], c[2], hashlib.sha256(joined.encode()).hexdigest(), joined


def texts():
    r = random.Random(7)
    bits = ["password", "Token", "API_KEY", "apikey", "ſecret", "é😀", " ", ":", "=", " = ", '"', "'", "abcdefgh12", "short", "AKIA", "AKIA1234567890AB", "0a1b2c3d" * 5, "secret=", "\n", "deadbeef", "-", "token:abcdefghi", "K"]
    out = ["".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(300)]
    return out + [None, "", "password=" * 300, "secret=token:abcdefghij", "x" * 100000 + " token=abcdefgh1"]


def test_base_spans_match_brute_force(spark):
    rows = list(enumerate(texts()))
    d = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, _spans string, start int")
    for r in S.report(d).collect():
        na, nk, nh, digest, joined = brute(rows[r.doc_id][1])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (na, nk, nh, digest), rows[r.doc_id]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_entropy_by_incremental_counts_equals_each_window(spark):
    r = random.Random(1)
    strings = ["".join(r.choice("aab1B/+xyzXYZ0987") for _ in range(n)) for n in (20, 21, 40, 75)] + ["a" * 30]
    got = [x.e for x in spark.createDataFrame([(s,) for s in strings], "s string").select(S.top_entropy(F.col("s")).alias("e")).collect()]
    for s, e in zip(strings, got):
        windows = [Counter(s[i : i + 20]).values() for i in range(len(s) - 19)]
        assert abs(e - max(-sum(c / 20 * math.log2(c / 20) for c in w) for w in windows)) < 1e-9


def test_random_strings_found_and_plain_ones_left(spark):
    key = "x8Kq2LmZ7vRt4WbN9cYp3HdF6"
    rows = [(1, f"use {key} now"), (2, "wp_content/uploads_of/pictures2024 and extraordinarycomplications12"), (3, "id 123e4567-e89b-42d3-a456-426614174000"), (4, "EXAMPLEx8Kq2LmZ7vRt4WbN9cYp"), (5, f"{key} {key}")]
    got = {r.doc_id: r.spans for r in S.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "entropy:4:29", 2: "", 3: "", 4: "", 5: "entropy:0:25,entropy:26:51"}


def test_redaction(spark):
    rows = list(enumerate(texts()))
    d = spark.createDataFrame([(i, t, len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, n_chars long")
    out = S.redact(d)
    assert out.columns == d.columns
    found = {r.doc_id: r.spans for r in S.report(d).collect()}
    for r in out.collect():
        t, at, parts = rows[r.doc_id][1], 0, []
        for x in filter(None, found[r.doc_id].split(",")):
            a, b = map(int, x.split(":")[1:])
            if a > at or not parts:
                parts += [t[at:a], S.REDACTED]
            at = max(at, b)
        assert r.text == ("".join(parts) + t[at:] if parts else t) and r.n_chars == (None if t is None else len(r.text))
    assert S.report(d.limit(0)).count() == 0


def entropy_spans(text):
    """Candidates by a plain scan, each window's entropy counted anew."""
    out, base = [], {(int(a), int(b)) for _, a, b in (x.split(":") for x in brute(text)[4].split(",") if x)}
    for m in re.finditer(S.CANDIDATE, text or "", re.A):
        s = m[0]
        classes = (("0123456789abcdefABCDEF", 2.9), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.5), ("abcdefghijklmnopqrstuvwxyz0123456789", 3.5))
        least = next((e for c, e in classes if set(s) <= set(c)), 3.7 if s.isalnum() else 3.8)
        top = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))
        if m.span() not in base and not re.search(S.ALLOWED, s, re.A) and top >= least:
            out.append(f"entropy:{m.start()}:{m.end()}")
    return out


def test_entropy_spans_match_brute_force(spark):
    r = random.Random(11)
    key = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    sets = ["abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghij0123456789", "aB3dE6gH9jK/+xYz-_", "aaaab1", "AKIA01234567"]
    rows = []
    for k in range(200):
        bits = [r.choice(["word", "password=", "secret: ", "id ", "\n", "é", "KEY=", "x/y/", "token = '"]) + key(r.choice(sets), r.choice([5, 19, 20, 33, 64])) for _ in range(r.randrange(6))]
        rows.append((k, r.choice(["", " ", "; "]).join(bits)))
    rows += [(200, None), (201, ""), (7, rows[7][1]), (None, "token=" + key(sets[3], 40))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x.doc_id, *sorted(x.spans.split(","))) for x in S.report(d).collect())
    want = Counter((i, *sorted([x for x in brute(t)[4].split(",") if x] + entropy_spans(t) or [""])) for i, t in rows)
    assert got == want and sum(len(entropy_spans(t)) for _, t in rows) > 50


def test_long_paths_and_many_matches(spark):
    """Paths of 100,000 segments, 20,000 assignments and as many random strings: no recursion, no time squared."""
    key = "x8Kq2LmZ7vRt4WbN9cYp3HdF6"
    many = " ".join(f"token=abcdefg{k:05d}" for k in range(20_000))
    rows = [(1, "see " + "a/" * 100_000 + "Zq9x8k7"), (2, "see " + "ab/" * 100_000 + "page12"), (3, many), (4, f"{key} " * 20_000), (5, "é" * 5000 + " token=abcdefghi " + "😀" * 9000 + key)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in S.report(d).collect()}
    clean = {r.doc_id: r.text for r in S.redact(d).collect()}
    assert time.time() - began < 60
    assert (got[3].n_assign, got[3].base_sha256) == (20_000, brute(many)[3]) and clean[3] == " ".join([S.REDACTED] * 20_000)
    assert got[2].spans == "" and clean[2] == rows[1][1]
    assert got[4].spans.count("entropy") == 20_000 and clean[4] == f"{S.REDACTED} " * 20_000
    assert clean[5] == "é" * 5000 + f" {S.REDACTED} " + "😀" * 9000 + S.REDACTED


def test_allowed_paths(spark):
    r = random.Random(2)
    old = re.compile(r"^([A-Za-z]+[/_-])*[A-Za-z]*[0-9]{0,4}$")
    strings = ["".join(r.choice(["ab", "Z", "/", "_", "-", "12", "7"]) for _ in range(r.randrange(9))) for _ in range(500)]
    new = S.ALLOWED[S.ALLOWED.rindex("|^") + 1 :]
    d = spark.createDataFrame([(s,) for s in strings], "s string")
    assert [x.m for x in d.select(F.regexp_like("s", F.lit(new)).alias("m")).collect()] == [bool(old.search(s)) for s in strings]
