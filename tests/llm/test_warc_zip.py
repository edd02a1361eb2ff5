import base64
import gzip
import hashlib
import io
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest

from tidemark.llm import warc_zip as Z


def brute(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        again = f is not None and (p is None or p > f)
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


ROWS = [(5, "http://a\n b", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", None), (2, "u", ""), (7, "u", "x" * 70000), (7, "u", "x" * 70000), (8, "u", "x" * 70000), (None, "u", "<p>é</p>"), (None, "u", "alone"), (None, "u", "alone"), (7, "u", "<p>é</p>")]


def test_written_and_read_back(spark):
    d = spark.createDataFrame([(*r, "k", 1) for r in ROWS], "page_id long, url string, html string, digest string, refers_to int")
    got = Z.report(d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS)
    assert Z.report(d.limit(0)).count() == 0


def test_payloads_small_archives_and_zip64(spark, tmp_path):
    d = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    for wide in (False, True):
        path = str(tmp_path / f"z{wide}")
        Z.write_archives(d, path, least=5, archive_bytes=300, zip64=wide)
        got = Z.read_archives(spark, path, with_payload=True).collect()
        assert len(got) == len(ROWS) and len(list(Path(path).glob("*.zip"))) > 1
        assert all(r.record_type == "response" for r in got if r.payload_bytes < 5)
        assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h in ROWS}
        for f in Path(path).glob("*.zip"):  # other readers agree
            with zipfile.ZipFile(f) as z:
                assert z.testzip() is None and z.namelist() == [Z.DATA, Z.INDEX]
                assert gzip.decompress(z.read(Z.DATA)).startswith(b"WARC/1.1")


def test_reads_zips_of_another_writer_and_refuses_damage():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.txt", b"stored bytes")
        z.writestr("b.txt", b"x" * 99, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 not the end"
    data = buf.getvalue()
    d = Z.ZipDirectory(pa.BufferReader(data), len(data))
    at, n = d.stored("a.txt")
    assert data[at : at + n] == b"stored bytes"
    with pytest.raises(ValueError):
        d.stored("b.txt")
    with pytest.raises(ValueError):
        Z.ZipDirectory(pa.BufferReader(data[:-40]), len(data) - 40)
