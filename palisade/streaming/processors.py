"""The detectors as one stateful operator, keyed by detector and what it watches.

Rows are held until the watermark passes them and then taken in order of event time, so that the result doesn't depend on
how batches are cut, and agrees with the detectors over finished data. A row that comes behind the watermark is taken on
arrival. Spark hands over a batch's rows before it fires timers; what has expired is therefore settled first, on any call.

A key's rows come packed, many in one (``packed``), are held like that, and are taken by array operations: state is read and written
once a call, and a key has one timer at a time for each thing it waits for."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade.config import BeaconRule, DnsModel, LoginRule
from palisade.schemas import ALERT, names

#: What the detectors watch. detail: of a login the raw line, of a query the name; value: of a login 1 if it failed, of a query its entropy.
WATCHED = "detector STRING, source_ip STRING, dest_ip STRING, event_ms BIGINT, value DOUBLE, detail STRING"
#: Rows of a key: times, values, lengths and bytes of the details, one after the other.
PACK = "times BINARY, numbers BINARY, lengths BINARY, details BINARY"
KEY = ["detector", "source_ip", "dest_ip"]
#: What the operator reads and writes.
PACKED = f"detector STRING, source_ip STRING, dest_ip STRING, {PACK}"
WRITTEN = f"kind STRING, {ALERT}, message STRING"
#: Rows that are packed at once; rows of a pack that is held; connections that are judged at once.
PACKED_ROWS, HELD_ROWS, JUDGED = 100_000, 100_000, 1 << 15


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WATCHED to PACKED: of so many rows those of a key become one."""
    got: list[pa.RecordBatch] = []
    for batch in batches:
        got.append(batch)
        if sum(map(len, got)) >= PACKED_ROWS:
            yield _grouped(pa.Table.from_batches(got))
            got = []
    if sum(map(len, got)):
        yield _grouped(pa.Table.from_batches(got))


def _grouped(rows: pa.Table) -> pa.RecordBatch:
    code = np.zeros(len(rows), np.int64)
    for c in KEY:
        own = rows[c].combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    rows, code = rows.take(pa.array(order)), code[order]
    cuts = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
    detail = pc.fill_null(rows["detail"].combine_chunks(), "").cast(pa.large_binary())
    at, value = rows["event_ms"].to_numpy(), rows["value"].to_numpy()
    packs = list(zip(*(pack(at[a:b], value[a:b], detail[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)), strict=True))
    keys = [rows[c].combine_chunks().take(pa.array(cuts[:-1])).cast(pa.string()) for c in KEY]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(x, pa.binary()) for x in packs)], names(PACKED))


def pack(at: np.ndarray, value: np.ndarray, detail: pa.Array) -> tuple[bytes, ...]:
    ends = np.frombuffer(detail.buffers()[1], np.int64)[detail.offset : detail.offset + len(detail) + 1]
    told = detail.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if ends[-1] > ends[0] else b""
    return at.astype(np.int64).tobytes(), value.astype(np.float64).tobytes(), np.diff(ends).astype(np.int32).tobytes(), told


def unpacked(packs: list[tuple]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    at, value, lengths = (np.concatenate([np.frombuffer(p[i], kind) for p in packs]) if packs else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.float64, np.int32)))
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    detail = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(p[3] for p in packs))])
    return at, value, detail


class Detectors(StatefulProcessor):
    def __init__(self, login: LoginRule = LoginRule(), beacon: BeaconRule = BeaconRule(), model: DnsModel = DnsModel()) -> None:  # noqa: B008
        self.login, self.beacon, self.model = login, beacon, model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", PACK)
        self.due = handle.getValueState("due", "first BIGINT")  # the time of the first row held
        self.windows = handle.getValueState("windows", "start ARRAY<BIGINT>, failed ARRAY<BIGINT>, total ARRAY<BIGINT>")
        self.channel = handle.getValueState("channel", "times ARRAY<BIGINT>, last_alert BIGINT, last BIGINT")
        self.queries = handle.getValueState("queries", "start BIGINT, n BIGINT, total DOUBLE, last STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        packs = [(r.times, r.numbers, r.lengths, r.details) for r in rows]
        if key[0] == "login":
            yield from self._logins(key, packs, watermark)
        else:
            yield from self._ordered(key, packs, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        yield from self.handleInputRows(key, iter(()), timerValues)

    def close(self) -> None:
        pass

    # Failed logins: counts by window, one alert when a window and its lateness are over

    def _logins(self, key: tuple, packs: list[tuple], watermark: int) -> Iterator[Row]:
        over = self.login.window_ms + self.login.allowed_lateness_ms
        counts = {s: [f, n] for s, f, n in zip(*self.windows.get(), strict=True)} if self.windows.exists() else {}
        ended = sorted(s for s in counts if s + over <= watermark)
        for start in ended:
            yield from self._login_alert(key, start, *counts.pop(start))
        for own in packs:
            at, failed, raw = unpacked([own])
            begin = at - at % self.login.window_ms
            late = begin + over <= watermark
            for line in raw.filter(pa.array(late)).cast(pa.large_string()).to_pylist():
                yield Row(kind="late", **dict.fromkeys(names(ALERT)), message=f"late_auth_event: {line}")
            starts, of = np.unique(begin[~late], return_inverse=True)
            for start, f, n in zip(starts.tolist(), np.bincount(of, failed[~late]).astype(int).tolist(), np.bincount(of).tolist(), strict=True):
                had = counts.setdefault(start, [0, 0])
                had[0] += f
                had[1] += n
        if counts:
            if ended or packs:
                self.windows.update((list(counts), [f for f, _ in counts.values()], [n for _, n in counts.values()]))
            self.handle.registerTimer(min(counts) + over)
        elif ended:
            self.windows.clear()

    def _login_alert(self, key: tuple, start: int, failed: int, total: int) -> Iterator[Row]:
        rule = self.login
        if failed >= rule.threshold:
            said = f"{failed} failed logins (of {total} total auth events) from {key[1]} in a {rule.window_ms // 60_000}-minute window (threshold={rule.threshold})"
            yield self._alert("failed_login_rate", start, start + rule.window_ms, "auth", key[1], None, min(1.0, failed / (rule.threshold * 3)), said)

    @staticmethod
    def _alert(kind: str, start: int, end: int, source: str, ip: str, dest: str | None, score: float, said: str) -> Row:
        values = {"alert_type": kind, "detected_at": datetime.now(UTC).replace(tzinfo=None), "window_start": _time(start), "window_end": _time(end), "source_type": source, "source_ip": ip, "dest_ip": dest, "score": float(score), "details": said}
        return Row(kind="alert", **values, message=None)

    # Beacons and queries: rows in order

    def _ordered(self, key: tuple, packs: list[tuple], watermark: int) -> Iterator[Row]:
        due = self.due.get()[0] if self.due.exists() else None
        firsts = [int(np.frombuffer(p[0], np.int64).min()) for p in packs]
        if due is not None:
            firsts.append(due)
        first = min(firsts, default=None)
        if first is not None and first <= watermark:
            at, value, detail = unpacked([*(tuple(x) for x in self.held.get()), *packs] if due is not None else packs)
            ready = at <= watermark
            order = np.flatnonzero(ready)
            if key[0] == "beacon":
                yield from self._connections(key, np.sort(at[order]))
            else:
                own = pa.table({"at": at[order], "detail": detail.take(pa.array(order))})
                order = order[pc.sort_indices(own, sort_keys=[("at", "ascending"), ("detail", "ascending")]).to_numpy()]
                yield from self._queries(key, at[order], value[order], detail.take(pa.array(order)))
            left = np.flatnonzero(~ready)
            if due is not None:
                self.held.clear()
            first = int(at[left].min()) if len(left) else None
            for a in range(0, len(left), HELD_ROWS):
                part = left[a : a + HELD_ROWS]
                self.held.appendValue(pack(at[part], value[part], detail.take(pa.array(part))))
        else:
            for own in packs:
                self.held.appendValue(own)
        if first is None:
            if due is not None:
                self.due.clear()
        else:
            if first != due:
                self.due.update((first,))
            self.handle.registerTimer(first)
        yield from self._settle(key, watermark, first is not None)

    def _settle(self, key: tuple, watermark: int, held: bool) -> Iterator[Row]:
        """Close what the watermark has passed."""
        if key[0] == "dns" and self.queries.exists():
            start, n, total, last = self.queries.get()
            if start + self.model.window_ms <= watermark:
                yield from self._dns_alert(key, start, n, total, last)
                self.queries.clear()
            else:
                self.handle.registerTimer(start + self.model.window_ms)
        if key[0] == "beacon" and self.channel.exists():
            idle = self.channel.get()[2] + self.beacon.session_gap_ms + 1
            if idle <= watermark and not held:
                self.channel.clear()
            elif idle > watermark:
                self.handle.registerTimer(idle)

    def _connections(self, key: tuple, at: np.ndarray) -> Iterator[Row]:
        """``at`` in order; what comes behind the last one that was taken goes one by one."""
        rule = self.beacon
        times, last_alert, last = self.channel.get() if self.channel.exists() else ([], None, None)
        times = list(times)
        behind = 0 if last is None else int(np.searchsorted(at, last, "left"))
        for x in at[:behind].tolist():
            times = sorted([*times, x][-rule.max_samples :])
            gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
            mean = sum(gaps) / len(gaps) if gaps else 0.0
            cv = sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / mean if mean > 0 else float("inf")
            if len(times) >= rule.min_samples and cv <= rule.max_cv and rule.min_interval_ms <= mean <= rule.max_interval_ms and (last_alert is None or x - last_alert >= int(mean * rule.cooldown_intervals)):
                last_alert = x
                yield self._beacon_alert(key, x, len(times), mean, cv)
        at = at[behind:]
        if len(at):
            before, most = len(times), rule.max_samples - 1
            seen = np.concatenate([np.array(times, np.int64), at])
            gap = np.diff(seen)
            new = np.concatenate([[True], gap > rule.session_gap_ms])
            new[1:before] = False
            begin = np.maximum.accumulate(np.where(new, np.arange(len(seen)), 0))  # where a place's session begins
            alerted = 0  # where the session of the last alert begins
            gaps = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(most, np.int64), gap]), most)
            for a in range(before, len(seen), JUDGED):
                place = np.arange(a, min(len(seen), a + JUDGED))
                n = np.minimum(place - begin[place], most)
                own = np.arange(most) >= most - n[:, None]
                gap = np.where(own, gaps[place], 0)
                mean = gap.sum(1) / np.maximum(n, 1)
                sd = np.sqrt((np.where(own, gap - mean[:, None], 0) ** 2).sum(1) / np.maximum(n, 1))
                cv = np.where(mean > 0, sd / np.where(mean > 0, mean, 1), np.inf)
                hit = np.flatnonzero((n + 1 >= rule.min_samples) & (cv <= rule.max_cv) & (mean >= rule.min_interval_ms) & (mean <= rule.max_interval_ms))
                for x, session, k, m, c in zip(seen[place[hit]].tolist(), begin[place[hit]].tolist(), n[hit].tolist(), mean[hit].tolist(), cv[hit].tolist(), strict=True):
                    if last_alert is None or session != alerted or x - last_alert >= int(m * rule.cooldown_intervals):
                        last_alert, alerted = x, session
                        yield self._beacon_alert(key, x, k + 1, m, c)
            session = int(begin[-1])
            times = seen[max(session, len(seen) - rule.max_samples) :].tolist()
            last_alert, last = last_alert if session == alerted else None, int(seen[-1])
        self.channel.update((times, last_alert, last))

    def _beacon_alert(self, key: tuple, at: int, samples: int, mean: float, cv: float) -> Row:
        said = f"{samples} outbound connections to {key[2]} at ~{mean / 1000:.1f}s intervals (coefficient of variation={cv:.3f}, threshold={self.beacon.max_cv:.3f})"
        return self._alert("beaconing", at - int(mean * samples), at, "firewall", key[1], key[2], max(0.0, 1 - cv), said)

    def _queries(self, key: tuple, at: np.ndarray, entropy: np.ndarray, query: pa.Array) -> Iterator[Row]:
        """``at`` in order."""
        start, n, total, last = self.queries.get() if self.queries.exists() else (None, 0, 0.0, None)
        i = 0
        while i < len(at):
            if start is None:
                start, n, total = int(at[i]), 0, 0.0
            end = max(i, int(np.searchsorted(at, start + self.model.window_ms, "left")))
            for x in entropy[i:end].tolist():
                total += x
            if end > i:
                n, last = n + end - i, query[end - 1].as_py().decode()
            if end < len(at):
                yield from self._dns_alert(key, start, n, total, last)
                start = None
            i = end
        self.queries.update((start, n, total, last))

    def _dns_alert(self, key: tuple, start: int, n: int, total: float, last: str) -> Iterator[Row]:
        m = self.model
        mean = total / n
        z = (mean - m.baseline_mean) / m.baseline_std if m.baseline_std > 0 else 0.0
        if n >= m.min_queries and z >= m.z_threshold:
            said = f"{n} DNS queries from {key[1]}, mean subdomain entropy {mean:.2f} bits/char (baseline {m.baseline_mean:.2f} +/- {m.baseline_std:.2f}, z-score {z:.2f}, threshold {m.z_threshold:.2f}). Example query: {last}"
            yield self._alert("dns_tunneling", start, start + m.window_ms, "dns", key[1], None, min(1.0, z / (m.z_threshold * 2)), said)
