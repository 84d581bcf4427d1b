import json
import os
import socket
import time

import pytest

from palisade.config import ShipperConfig
from palisade.sources.shipper import Shipper, Tail, spool


def config(**more):
    return ShipperConfig.from_dict({"sources": [{"type": "tail", "source_type": "auth", "path": "/nowhere"}], "batch_timeout": "100ms"} | more)


def test_tail_follows_rotation(tmp_path):
    path = tmp_path / "a.log"
    t = Tail(str(path))
    assert list(t.lines()) == []
    path.write_bytes(b"one\r\n\ntwo\nhal")
    assert list(t.lines()) == ["one", "two"]
    with open(path, "ab") as f:
        f.write(b"f\n")
    assert list(t.lines()) == ["half"]
    os.rename(path, tmp_path / "a.log.1")
    path.write_bytes(b"new\n")
    assert list(t.lines()) == ["new"]
    path.write_bytes(b"x\n")
    assert list(t.lines()) == ["x"]
    later = Tail(str(path))
    assert list(later.lines()) == []
    assert list(Tail(str(path), from_start=True).lines()) == ["x"]


def test_retries_and_drops():
    tries, pauses = [], []

    def send(batch):
        tries.append(len(batch))
        if len(tries) < 3:
            raise OSError

    s = Shipper(config(), send, pauses.append)
    assert s.deliver(["a", "b"])
    assert pauses == [0.2, 0.4]
    assert (s.counters.sent, s.counters.failed_tries) == (2, 2)

    def never(batch):
        raise OSError

    s = Shipper(config(max_retries=2, max_backoff="300ms"), never, pauses.append)
    assert not s.deliver(["a"])
    assert pauses[2:] == [0.2, 0.3]
    assert s.counters.dropped == 1
    assert "palisade_shipper_dropped 1" in s.counters.text()


def test_end_to_end(spark, tmp_path):
    log = tmp_path / "auth.log"
    log.write_text("".join(f"line {i}\n" for i in range(25)))
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    sources = [{"type": "tail", "source_type": "auth", "path": str(log), "from_start": True}, {"type": "syslog", "source_type": "dns", "address": f"127.0.0.1:{port}"}]
    ship = Shipper(config(sources=sources, batch_size=10), spool(f"{tmp_path}/spool"))
    ship.start()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto(b"query 1\n", ("127.0.0.1", port))
    until = time.monotonic() + 10
    while ship.counters.sent < 26 and time.monotonic() < until:
        time.sleep(0.05)
    ship.stop()
    got = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/spool").collect()]
    assert sorted((x["source_type"], x["raw"]) for x in got) == sorted([("auth", f"line {i}") for i in range(25)] + [("dns", "query 1")])
    assert max(len(open(os.path.join(tmp_path, "spool", f)).readlines()) for f in os.listdir(tmp_path / "spool")) <= 10


@pytest.mark.parametrize("bad", [{"batch_timeout": "x"}, {"queue_size": 0}])
def test_bad_settings(bad):
    with pytest.raises(ValueError):  # noqa: PT011
        config(**bad)
