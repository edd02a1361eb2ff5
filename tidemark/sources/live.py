"""Streaming sources of services that are read by HTTP: a chain followed from a point, and lists read by page.

Both keep their place as the stream's offsets, so a stream that is stopped and started again goes on where its last finished batch
ended, and a batch that failed is read again as it was. Register with ``spark.dataSource.register``.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader


class UnknownCheckpoint(Exception):
    """The service doesn't know the point from which it is asked to go on."""


class RateLimited(Exception):
    """The service asks to be left alone for longer than ``patience`` seconds."""


class Client:
    """GETs of JSON, ``rate`` a second at most, with ``tries`` tries where the service fails or is too busy. Where it says how long to wait,
    that is waited for, ``patience`` seconds at most."""

    def __init__(self, options):
        self.url, self.rate = options["url"].rstrip("/"), float(options.get("rate", 10))
        self.tries, self.patience, self.pause = int(options.get("tries", 3)), float(options.get("patience", 60)), float(options.get("pause", 1))
        self.tokens, self.at = 1.0, time.monotonic()

    def _take(self) -> None:
        now = time.monotonic()
        self.tokens, self.at = min(max(1.0, self.rate), self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            time.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, time.monotonic()
        self.tokens -= 1

    def get(self, path: str, **query):
        """What the service answers; None where it doesn't know what is asked for."""
        target = f"{self.url}/{path}?{urllib.parse.urlencode(query)}"
        for k in range(self.tries):
            self._take()
            wait = self.pause * 2**k
            try:
                with urllib.request.urlopen(target, timeout=30) as r:
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code == 429:
                    wait = float(e.headers.get("Retry-After") or wait)
                    if wait > self.patience:
                        raise RateLimited(f"{target}: asked to wait {wait:g} seconds") from e
                elif e.code < 500:
                    raise
                if k + 1 == self.tries:
                    raise RateLimited(target) if e.code == 429 else e
            except OSError:
                if k + 1 == self.tries:
                    raise
            time.sleep(wait)


class _Chain(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.client, self.start, self.count = Client(options), options.get("from"), int(options.get("count", 100))

    def initialOffset(self) -> dict:
        """The point given as ``from`` (slot:id), else the tip."""
        if self.start:
            slot, _, name = self.start.partition(":")
            return {"slot": int(slot), "id": name}
        tip = self.client.get("tip")
        return {"slot": tip["slot"], "id": tip["id"]}

    def _after(self, start: dict, count: int) -> list[dict]:
        events = self.client.get("next", slot=start["slot"], id=start["id"], count=count)
        if events is None:
            raise UnknownCheckpoint(f"{start['slot']}:{start['id']}")
        return events

    @staticmethod
    def _row(e: dict) -> tuple:
        return (e.get("direction", "forward"), e["slot"], e["id"], json.dumps(e.get("block")) if e.get("block") is not None else None)

    def read(self, start: dict):
        events = self._after(start, self.count)
        end = {"slot": events[-1]["slot"], "id": events[-1]["id"]} if events else start
        return iter([self._row(e) for e in events]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch again. What the chain took back in between comes as the events that say so."""
        while start != end:
            events = self._after(start, self.count)
            if not events:
                raise UnknownCheckpoint(f"{end['slot']}:{end['id']}")
            for e in events:
                yield self._row(e)
                start = {"slot": e["slot"], "id": e["id"]}
                if start == end:
                    return


class ChainSource(DataSource):
    """Stream of a chain's events: direction (forward, or backward to a point that is taken to be the last), slot, id, block (JSON).

    The service answers ``tip`` with a point (slot, id) and ``next?slot&id&count`` with the events after a point, or 404 where it has no
    such point, which is an error: the stream never goes back to the beginning by itself. A first run begins at the tip, or at the
    option ``from`` (``slot:id``). Other options: url, count (events of a batch), rate, tries, patience.
    """

    @classmethod
    def name(cls) -> str:
        return "chain_events"

    def schema(self) -> str:
        return "direction string, slot long, id string, block string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Chain(self.options)


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class _PageStream(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.first, self.most = dict(options), int(options.get("first", 1)), int(options.get("pages", 8))
        self.reached = None

    def initialOffset(self) -> dict:
        return {"page": self.first - 1}

    def latestOffset(self) -> dict:
        """As far as the service has whole pages, ``pages`` further than before at most; not further while it asks to be left alone."""
        try:
            whole = Client(self.options).get("pages")["whole"]
        except RateLimited:
            return {"page": self.reached if self.reached is not None else self.first - 1}
        now = self.reached if self.reached is not None else self.first - 1
        self.reached = max(now, min(whole, now + self.most))
        return {"page": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = max(self.reached or 0, end["page"])
        return [_Page(k) for k in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        items = Client(self.options).get("page", number=partition.value)
        if items is None:
            raise UnknownCheckpoint(f"page {partition.value}")
        for item in items:
            yield (partition.value, json.dumps(item))

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached or 0, end["page"])


class PageStreamSource(DataSource):
    """Stream of a list's pages (page, item as JSON), each read by a task of its own and a batch of ``pages`` pages at most.

    The service answers ``pages`` with how many whole pages there are, so a page that still grows isn't read, and ``page?number`` with
    a page's items. Options: url, first, pages, rate (of a task), tries, patience.
    """

    @classmethod
    def name(cls) -> str:
        return "json_page_stream"

    def schema(self) -> str:
        return "page int, item string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PageStream(self.options)
