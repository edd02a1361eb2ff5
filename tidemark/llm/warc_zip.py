"""Web archives packaged in ZIP files, read by ranges.

An archive is a ZIP of two stored (uncompressed) members: ``archive/data.warc.gz``, a WARC/1.1 file of records each
compressed alone, and ``indexes/index.cdx``, a line for each record with its offset and length in the data member. The
reader takes the end of the file, finds the end-of-central-directory record (and its ZIP64 form), lists the members, finds
where the stored ones begin, and reads the index and then records, neighbours in one read. Nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import materialise, scratch, utf8
from tidemark.llm.token_store import file_system

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: An archive is closed and another begun beyond this many bytes of records.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 4 << 20
LEVEL = 2
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BIG = 0xFFFFFFFF


class StoredZip:
    """Writes a ZIP of stored members to a stream that can't seek: sizes follow each member and are in the directory.

    ``zip64`` writes the ZIP64 fields even where the sizes don't ask for them.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        # version 4.5, flags: sizes follow (8) and UTF-8 names (0x800); method 0; 1980-01-01
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x808, 0, 0, 0x21, 0, 0, 0, len(self.name), 0) + self.name)

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)

    def end(self) -> None:
        wide = self.zip64 or self.size >= _BIG
        self._put(struct.pack("<IIQQ" if wide else "<III" + "I", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.start, self.crc, self.size))

    def close(self) -> None:
        first = self.at
        for name, start, crc, size in self.members:
            wide_size, wide_start = self.zip64 or size >= _BIG, self.zip64 or start >= _BIG
            more = struct.pack("<QQ", size, size) * wide_size + struct.pack("<Q", start) * wide_start
            extra = struct.pack("<HH", 1, len(more)) + more if more else b""
            self._put(
                struct.pack(
                    "<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x808, 0, 0, 0x21, crc, *((_BIG,) * 2 if wide_size else (size,) * 2),
                    len(name), len(extra), 0, 0, 0, 0, _BIG if wide_start else start,
                ) + name + extra
            )
        size, n = self.at - first, len(self.members)
        if self.zip64 or first >= _BIG or size >= _BIG or n >= 0xFFFF:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, first))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            n, size, first = 0xFFFF, _BIG, _BIG
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, first, 0))


class ZipDirectory:
    """Members of a ZIP in a random-access file: name -> (method, place of the data, size)."""

    def __init__(self, file, length: int):
        self.file = file
        tail_at = max(0, length - 65_557 - 20)
        tail = file.read_at(length - tail_at, tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        n, size, first = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07" and (n == 0xFFFF or size == _BIG or first == _BIG):
            (wide_at,) = struct.unpack_from("<Q", tail, at - 12)
            wide = file.read_at(56, wide_at)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of the central directory")
            n, size, first = struct.unpack_from("<QQQ", wide, 32)
        directory, at = file.read_at(size, first), 0
        self.members: dict[str, tuple[int, int, int]] = {}
        for _ in range(n):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            method, packed, plain, names, extras, notes = struct.unpack_from("<H8xIIHHH", directory, at + 10)
            (start,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + names].decode()
            e, stop = at + 46 + names, at + 46 + names + extras
            while e + 4 <= stop:
                kind, width = struct.unpack_from("<HH", directory, e)
                if kind == 1:
                    fields = [*struct.unpack_from(f"<{width // 8}Q", directory, e + 4)]
                    if plain == _BIG:
                        plain = fields.pop(0)
                    if packed == _BIG:
                        packed = fields.pop(0)
                    if start == _BIG:
                        start = fields.pop(0)
                e += 4 + width
            self.members[name] = (method, start, packed)
            at = stop + notes

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's data begins, and its size."""
        method, start, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed")
        head = self.file.read_at(30, start)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no header")
        names, extras = struct.unpack_from("<HH", head, 26)
        return start + 30 + names + extras, size


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(text: str | None) -> str:
    """A header's value on one line."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """A WARC record: a response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\n"
        f"WARC-Target-URI: {_plain(url)}\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
        + ("" if refers_to is None else f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n")
        + f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's headers, its HTTP headers and its payload."""
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = data[cut + 4 : cut + 4 + int(head["content-length"])]
    split = block.index(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:split].decode().split("\r\n")[1:])}
    return head, http, block[split + 4 :]


MANIFEST = "archive string, n_records long, n_bytes long"


def _writer(path: str, archive_bytes: int, zip64: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        out = None
        for batch in batches:
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.zip"  # a task that runs twice leaves a file that no manifest names
                    out = fs.open_output_stream(f"{root}/{name}")
                    z, lines = StoredZip(out, zip64), []
                    z.begin(DATA)
                payload = html.as_py() or b""
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = pack.compress(record(page_id, url, payload, refers_to, digest_of(payload))) + pack.flush()
                lines.append(f"{'-' if page_id is None else page_id} {z.size} {len(data)} {'response' if refers_to is None else 'revisit'}\n")
                z.write(data)
                if z.size >= archive_bytes:
                    yield finish(out, z, lines, name)
                    out = None
        if out is not None:
            yield finish(out, z, lines, name)

    def finish(out, z: StoredZip, lines: list[str], name: str) -> pa.RecordBatch:
        z.end()
        z.begin(INDEX)
        z.write("".join(lines).encode())
        z.end()
        z.close()
        out.close()
        return pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([len(lines)], pa.int64()), "n_bytes": pa.array([z.at], pa.int64())})

    return write


def write_archives(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> None:
    """Writes a record for each page (page_id, url, html) to archives at ``path``, a shared folder.

    Of pages with equal payloads of at least ``least`` bytes that with the smallest page_id is a response, and the others
    revisit it; rows that repeat that id with that payload are responses too. A null html is an empty payload; a null
    page_id is larger than all others, and where a payload has only such rows they are all responses.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("html"))
    known = rows.select("page_id", F.unhex(F.sha1("html")).alias("digest"), F.length("html").cast("long").alias("n")).filter(F.col("n") >= least)
    firsts = known.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).filter("k > 1 and refers_to is not null")
    again = known.join(firsts, ["digest", "n"]).filter("page_id is null or page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    # written, so that its size is known when the join with the pages is planned
    again = materialise(again, "revisits").withColumnRenamed("page_id", "p").withColumnRenamed("digest", "d")
    marked = rows.withColumn("digest", F.unhex(F.sha1("html")))
    marked = marked.join(again, marked["page_id"].eqNullSafe(again["p"]) & (marked["digest"] == again["d"]), "left")
    out = marked.select("page_id", "url", "html", "refers_to").mapInArrow(_writer(path, archive_bytes, zip64), MANIFEST)
    out.write.parquet(f"{path}/manifest")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(path: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for batch in batches:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    directory = ZipDirectory(f, length)
                    start, _ = directory.stored(DATA)
                    at, size = directory.stored(INDEX)
                    entries = [line.split() for line in f.read_at(size, at).decode().splitlines()]
                    spans = [(int(e[1]), int(e[2])) for e in entries]
                    a = 0
                    while a < len(spans):
                        b = a + 1
                        while b < len(spans) and spans[b][0] + spans[b][1] - spans[a][0] <= READ_BYTES:
                            b += 1
                        data = f.read_at(spans[b - 1][0] + spans[b - 1][1] - spans[a][0], start + spans[a][0])
                        yield batch_of([zlib.decompress(data[o - spans[a][0] : o - spans[a][0] + n], 31) for o, n in spans[a:b]])
                        a = b

    def batch_of(records: list[bytes]) -> pa.RecordBatch:
        cols: dict[str, list] = {k: [] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
        number = lambda urn: int(urn[len("<urn:page:") : -1]) if urn not in ("", "<urn:page:>") else None
        for r in records:
            head, http, payload = parse(r)
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            if head["warc-type"] == "response" and digest_of(payload) != digest:
                raise ValueError(f"payload of {head['warc-record-id']} is damaged")
            cols["page_id"].append(number(head["warc-record-id"]))
            cols["url"].append(head.get("warc-target-uri"))
            cols["payload_bytes"].append(int(http["content-length"]))
            cols["payload_digest"].append(digest)
            cols["record_type"].append(head["warc-type"])
            cols["refers_to"].append(number(head.get("warc-refers-to", "")))
            cols["payload"].append(payload if head["warc-type"] == "response" else None)
        types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        if with_payload:
            types["payload"] = pa.binary()
        return pa.RecordBatch.from_pydict({k: pa.array(cols[k], t) for k, t in types.items()})

    return read


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives that the manifest at ``path`` names; a damaged archive is an error.

    ``with_payload`` adds the payload: a response's own, null for a revisit.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("archive", "n_bytes")
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(_reader(path, with_payload), RECORDS + ", payload binary" * with_payload)


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, read back from written archives."""
    path = scratch(pages.sparkSession, "archives")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).drop("url")
