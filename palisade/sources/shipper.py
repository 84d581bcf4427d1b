"""A log shipper: follows files and listens to syslog, and spools envelopes, in batches, to a folder that a stream reads.

A batch is one file of JSON lines that appears as a whole, so that the stream never sees half of it, and reads it once."""

from __future__ import annotations

import json
import os
import queue
import socket
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from palisade.config import ShipperConfig, duration_ms

# The pause between looks at a file, and the largest datagram.
POLL_S = 0.5
DATAGRAM = 65_536


def envelope(source_type: str, raw: str, host: str | None = None, at: datetime | None = None) -> str:
    return json.dumps({"source_type": source_type, "host": host or socket.gethostname(), "received_at": (at or datetime.now(UTC)).isoformat().replace("+00:00", "Z"), "raw": raw})


class Tail:
    """Whole lines of a file as they are added; a file that is replaced or cut is read from its beginning. It may not be there yet."""

    def __init__(self, path: str, from_start: bool = False) -> None:
        self.path, self.inode, self.at = path, None, 0
        self.rest = b""
        if not from_start and os.path.exists(path):
            s = os.stat(path)
            self.inode, self.at = s.st_ino, s.st_size

    def lines(self) -> Iterator[str]:
        """What has been added since the last call; a line without its end is left for later."""
        try:
            with open(self.path, "rb") as f:
                s = os.fstat(f.fileno())
                if s.st_ino != self.inode or s.st_size < self.at:
                    self.inode, self.at, self.rest = s.st_ino, 0, b""
                f.seek(self.at)
                data = f.read()
                self.at = f.tell()
        except FileNotFoundError:
            return
        *whole, self.rest = (self.rest + data).split(b"\n")
        for line in whole:
            if text := line.rstrip(b"\r").decode("utf-8", "replace"):
                yield text


class Syslog:
    """Datagrams, one event each."""

    def __init__(self, address: str) -> None:
        host, _, port = address.rpartition(":")
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 8 << 20)
        self.socket.bind((host or "0.0.0.0", int(port)))  # noqa: S104
        self.socket.settimeout(POLL_S)

    def lines(self) -> Iterator[str]:
        try:
            data, _ = self.socket.recvfrom(DATAGRAM)
        except TimeoutError:
            return
        if text := data.decode("utf-8", "replace").rstrip("\r\n"):
            yield text


@dataclass
class Counters:
    received: int = 0
    sent: int = 0
    dropped: int = 0
    failed_tries: int = 0
    queued: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def add(self, **more: int) -> None:
        with self.lock:
            for k, v in more.items():
                setattr(self, k, getattr(self, k) + v)

    def text(self) -> str:
        return "".join(f"palisade_shipper_{k} {getattr(self, k)}\n" for k in ("received", "sent", "dropped", "failed_tries", "queued"))


def spool(folder: str) -> Callable[[list[str]], None]:
    """Writes a batch as a file that appears as a whole."""
    os.makedirs(folder, exist_ok=True)

    def send(batch: list[str]) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        hidden = os.path.join(folder, f".{name}")
        with open(hidden, "w", encoding="utf-8") as f:
            f.write("\n".join(batch) + "\n")
        os.rename(hidden, os.path.join(folder, f"{name}.json"))

    return send


class Shipper:
    def __init__(self, config: ShipperConfig, send: Callable[[list[str]], None], sleep: Callable[[float], None] = time.sleep) -> None:
        self.config, self.send, self.sleep = config, send, sleep
        self.counters = Counters()
        self.queue: queue.Queue[str] = queue.Queue(config.queue_size)  # sources wait while it is full
        self.stopped = threading.Event()
        self.threads: list[threading.Thread] = []

    def deliver(self, batch: list[str]) -> bool:
        """Send, again after a doubling pause if it fails; a batch is dropped after the last try."""
        pause, most = duration_ms(self.config.retry_backoff), duration_ms(self.config.max_backoff)
        for n in range(self.config.max_retries + 1):
            try:
                self.send(batch)
            except OSError:
                self.counters.add(failed_tries=1)
                if n < self.config.max_retries:
                    self.sleep(min(pause, most) / 1000)
                    pause *= 2
            else:
                self.counters.add(sent=len(batch))
                return True
        self.counters.add(dropped=len(batch))
        return False

    def follow(self, source: Tail | Syslog, source_type: str) -> None:
        while not self.stopped.is_set():
            for line in source.lines():
                self.queue.put(envelope(source_type, line))
                self.counters.add(received=1, queued=1)
            if isinstance(source, Tail):
                self.stopped.wait(POLL_S)

    def batches(self) -> None:
        """Deliver when a batch is full or old, and what is left at the end."""
        batch: list[str] = []
        age = duration_ms(self.config.batch_timeout) / 1000
        due = time.monotonic() + age
        while not (self.stopped.is_set() and self.queue.empty()):
            try:
                batch.append(self.queue.get(timeout=max(0.0, min(0.1, due - time.monotonic()))))
                self.counters.add(queued=-1)
            except queue.Empty:
                pass
            if len(batch) >= self.config.batch_size or time.monotonic() >= due:
                if batch:
                    self.deliver(batch)
                batch, due = [], time.monotonic() + age
        if batch:
            self.deliver(batch)

    def start(self) -> None:
        for s in self.config.sources:
            source = Tail(s["path"], s.get("from_start", False)) if s["type"] == "tail" else Syslog(s["address"])
            self.threads.append(threading.Thread(target=self.follow, args=(source, s["source_type"]), daemon=True))
        self.threads.append(threading.Thread(target=self.batches, daemon=True))
        for t in self.threads:
            t.start()

    def stop(self) -> None:
        """Stop reading; what has been read is delivered."""
        self.stopped.set()
        for t in self.threads:
            t.join()
