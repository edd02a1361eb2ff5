import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tidemark.sources.live import ChainSource, Client, PageStreamSource, RateLimited
from tidemark.streaming import retry


class Service:
    """A chain of events and a list of pages, over HTTP."""

    def __init__(self):
        self.events, self.pages, self.refuse, self.asked = [{"slot": 0, "id": "b0"}], [], 0, []
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urlparse(self.path)
                q = {k: v[0] for k, v in parse_qs(url.query).items()}
                service.asked.append(url.path)
                if service.refuse:
                    service.refuse -= 1
                    self.send_response(429)
                    self.send_header("Retry-After", service.wait)
                    self.end_headers()
                    return
                answer = service.answer(url.path, q)
                body = json.dumps(answer).encode()
                self.send_response(404 if answer is None else 200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server, self.wait = ThreadingHTTPServer(("127.0.0.1", 0), Handler), "0"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"

    def answer(self, path, q):
        if path == "/tip":
            return {k: self.events[-1][k] for k in ("slot", "id")}
        if path == "/next":
            at = next((k for k, e in reversed(list(enumerate(self.events))) if (str(e["slot"]), e["id"]) == (q["slot"], q["id"])), None)
            return None if at is None else self.events[at + 1 : at + 1 + int(q["count"])]
        if path == "/pages":
            return {"whole": len(self.pages)}
        return self.pages[int(q["number"]) - 1] if int(q["number"]) <= len(self.pages) else None


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def run(spark, stream, path):
    """What a stream gives until nothing is left, appended to ``path``."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def test_a_chain_goes_on_where_it_stopped(spark, service, tmp_path):
    spark.dataSource.register(ChainSource)
    stream = lambda **o: spark.readStream.format("chain_events").options(url=service.url, pause=0.01, **o).load()
    service.events += [{"slot": k, "id": f"b{k}", "block": {"n": k}} for k in range(1, 4)]
    got = run(spark, stream(**{"from": "1:b1", "count": "2"}), str(tmp_path))
    assert sorted(r.id for r in got.collect()) == ["b2", "b3"]
    service.events += [{"slot": 2, "id": "b2", "direction": "backward"}, {"slot": 5, "id": "c5", "block": {"n": 5}}]
    got = run(spark, stream(**{"from": "1:b1"}), str(tmp_path))
    assert sorted((r.direction, r.id) for r in got.collect()) == [("backward", "b2"), ("forward", "b2"), ("forward", "b3"), ("forward", "c5")]
    assert {r.id: r.block for r in got.filter("block is not null").collect()}["c5"] == '{"n": 5}'


def test_an_unknown_point_is_an_error_and_a_first_run_begins_at_the_tip(spark, service, tmp_path):
    spark.dataSource.register(ChainSource)
    stream = lambda **o: spark.readStream.format("chain_events").options(url=service.url, pause=0.01, **o).load()
    with pytest.raises(Exception, match="UnknownCheckpoint"):
        run(spark, stream(**{"from": "9:gone"}), f"{tmp_path}/a")
    service.events.append({"slot": 4, "id": "b4"})
    assert run(spark, stream(), f"{tmp_path}/b").count() == 0


def test_pages_are_read_once_by_tasks_of_their_own(spark, service, tmp_path):
    spark.dataSource.register(PageStreamSource)
    stream = lambda: spark.readStream.format("json_page_stream").options(url=service.url, pages="2", rate="1000", pause=0.01).load()
    service.pages = [[{"n": 10 * p + k} for k in range(3)] for p in range(5)]
    service.refuse = 2
    got = run(spark, stream(), str(tmp_path))
    want = [10 * p + k for p in range(5) for k in range(3)]
    assert sorted(json.loads(r.item)["n"] for r in got.collect()) == want
    service.pages.append([{"n": 99}])
    got = run(spark, stream(), str(tmp_path))
    assert sorted(json.loads(r.item)["n"] for r in got.collect()) == want + [99]
    assert service.asked.count("/page") == 6


def test_rates_and_limits(service):
    c = Client({"url": service.url, "rate": "20", "pause": "0.01"})
    began = time.monotonic()
    for _ in range(11):
        c.get("tip")
    assert time.monotonic() - began >= 0.45
    service.refuse, service.wait = 1, "3600"
    with pytest.raises(RateLimited):
        c.get("tip")
    assert c.get("nowhere", number=9) is None


def recover_never(network, tx):
    return None


class RecoverLater:
    """Gives the payload at the second attempt, by a file that the first leaves."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, network, tx):
        import os

        path = f"{self.folder}/{tx}"
        if os.path.exists(path):
            return f'{{"id": "{tx}"}}'
        open(path, "w").close()
        raise OSError("not yet")


@pytest.mark.parametrize("how", ["never", "later"])
def test_three_attempts_and_then_the_mark(spark, tmp_path, how):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retry.PROVIDER)
    source, folder = tmp_path / "in", tmp_path / "asked"
    source.mkdir(), folder.mkdir()
    rows = [("fine", '{"id": "fine"}', False), ("cut", '{"id": "c', True), ("none", None, False), ("broken", "{", False)]
    (source / "a.json").write_text("\n".join(json.dumps({"network": "n", "tx_hash": h, "raw_data": r, "raw_data_truncated": t}) for h, r, t in rows))
    txs = spark.readStream.schema("network string, tx_hash string, raw_data string, raw_data_truncated boolean").json(str(source))
    out = retry.with_payloads(txs, recover_never if how == "never" else RecoverLater(str(folder)), pace=2)
    name = f"held_{how}"
    query = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and (spark.table(name).count() < 4 or query.exception()):
            assert query.exception() is None, query.exception()
            time.sleep(0.5)
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r.tx_hash: (r.raw_data, r.attempts, r.evidence) for r in spark.table(name).collect()}
    assert got["fine"] == ('{"id": "fine"}', 0, None) and got["none"] == (None, 0, None)
    want = (None, 3, retry.UNAVAILABLE) if how == "never" else ('{"id": "cut"}', 2, None)
    assert got["cut"] == want and got["broken"][1:] == want[1:]
