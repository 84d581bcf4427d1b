"""The stateful operator at many rows and windows a key, without Spark: its results, and how often it asks for state."""

from collections import Counter

import pyarrow as pa

from palisade.schemas import names
from palisade.streaming.processors import PACK, WATCHED, Detectors, packed

CALLS = Counter()


class Value:
    def __init__(self):
        self.x = None

    def __getattr__(self, name):
        def call(*args):
            CALLS[name] += 1
            if name == "get":
                return self.x
            if name == "exists":
                return self.x is not None and self.x != []
            self.x = args[0] if name == "update" else [*(self.x or []), args[0]] if name == "appendValue" else None
            return self.x

        return call


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):  # noqa: N802
        return Value()

    getListState = getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        CALLS["registerTimer"] += 1
        self.timers.add(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def rows_of(detector, rows):
    """Packs of (event_ms, value, detail) of one key."""
    columns = [[detector] * len(rows), ["10.0.0.1"] * len(rows), ["10.0.0.2"] * len(rows), *map(list, zip(*rows, strict=True))]
    types = {"STRING": pa.string(), "BIGINT": pa.int64(), "DOUBLE": pa.float64()}
    batch = pa.RecordBatch.from_arrays([pa.array(c, types[x.split()[1]]) for c, x in zip(columns, WATCHED.split(", "), strict=True)], names(WATCHED))
    return [type("Pack", (), {n: r[n] for n in names(PACK)}) for out in packed(iter([batch])) for r in out.to_pylist()]


def run(detector, batches):
    """Alerts of batches (rows, watermark), each followed by the timers that are due."""
    own, handle, out = Detectors(), Handle(), []
    own.init(handle)
    CALLS.clear()
    key = (detector, "10.0.0.1", "10.0.0.2")
    for rows, watermark in batches:
        out += own.handleInputRows(key, iter(rows_of(detector, rows) if rows else []), Clock(watermark))
        while due := [t for t in handle.timers if t <= watermark]:
            handle.timers.remove(due[0])
            out += own.handleExpiredTimer(key, Clock(watermark), None)
    return [(r.kind, r.window_start, r.details or r.message) for r in out]


def test_many_windows_take_few_calls():
    rows = [(i * 20_000, 1.0, f"line {i}") for i in range(6_000)]  # 15 a window, 400 windows
    got = run("login", [(rows, 0), ([(5, 1.0, "late")], 200_000_000)])
    assert [k for k, *_ in got] == ["alert"] * 400 + ["late"]
    assert got[0][2].startswith("15 failed logins (of 15") and got[-1][2] == "late_auth_event: late"
    assert sum(CALLS.values()) < 20


def test_many_rows_take_few_calls():
    beacon = [(i * 30_000, 0.0, None) for i in range(5_000)]
    whole = run("beacon", [(beacon, 0), ([], 10**10)])
    assert sum(CALLS.values()) < 40
    assert len(whole) == (5_000 - 5) // 3 + 1
    assert run("beacon", [(beacon[i : i + 7], beacon[i][0] - 1) for i in range(0, 5_000, 7)] + [([], 10**10)]) == whole
    queries = [(i * 5_000, 4.0 + i % 3, f"q{i}") for i in range(6_000)]
    whole = run("dns", [(queries, 0), ([], 10**10)])
    assert sum(CALLS.values()) < 40
    assert len(whole) == 500 and "12 DNS queries" in whole[0][2] and whole[0][2].endswith("q11")
    assert run("dns", [(queries[i : i + 7], queries[i][0] - 1) for i in range(0, 6_000, 7)] + [([], 10**10)]) == whole


def test_a_connection_behind_the_watermark_is_taken_on_arrival():
    rows = [(i * 30_000, 0.0, None) for i in range(20)]
    got = run("beacon", [(rows, 0), ([], 30_000 * 19), ([(30_000 * 7 + 1, 0.0, None)], 30_000 * 19), ([(30_000 * 20, 0.0, None)], 30_000 * 25)])
    assert [k for k, *_ in got] == ["alert"] * 6
