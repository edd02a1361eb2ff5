import json
import time

import pytest

from tidemark.streaming import ledger


def state_rows(query, want, seconds=60):
    """Rows of state once they are as many as wanted, or the last count."""
    until, rows = time.time() + seconds, None
    while time.time() < until and rows != want:
        time.sleep(0.5)
        if progress := query.lastProgress:
            rows = sum(s["numRowsTotal"] for s in progress["stateOperators"])
    return rows


@pytest.mark.parametrize("stream", ["pending", "life"])
def test_state_that_nothing_asks_for_is_dropped(spark, tmp_path, stream):
    write = lambda name, *rows: (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
    if stream == "pending":
        write("a.json", {"tx": "a", "at": 1.0, "refs": ["r", "s"]})
        out = ledger.pending_collisions(spark.readStream.schema("tx string, at double, refs array<string>").json(str(tmp_path)), idle=2)
    else:
        write("a.json", {"tx_id": "t", "event": "confirmed", "at": "2024-01-01T00:00:00Z"}, {"tx_id": "u", "event": "seen", "at": "2024-01-01T00:00:00Z"})
        out = ledger.lifecycle_stream(spark.readStream.schema("tx_id string, event string, at timestamp").json(str(tmp_path)), ttl=2, settled=2)
    query = out.writeStream.format("memory").queryName(f"left_{stream}").outputMode("append").start()
    try:
        assert state_rows(query, 2) == 2
        assert state_rows(query, 0) == 0
    finally:
        query.stop()
    got = [tuple(r)[:2] for r in spark.table(f"left_{stream}").collect()]
    assert got == [] if stream == "pending" else sorted(got) == [("t", "CONFIRMED"), ("u", "DROPPED"), ("u", "PENDING")]
