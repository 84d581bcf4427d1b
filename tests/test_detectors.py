import json
import random

import pytest

from palisade.config import BeaconRule, DnsModel, Job, LoginRule, ShipperConfig, duration_ms
from palisade.operators import detectors, report, training
from palisade.operators.scan import picked
from palisade.schemas import EVENT

BASE = 1_700_000_000_000
FAR = [0, 30_400, 59_700, 90_200, 119_900, 150_500]
TEST_RULE = BeaconRule(max_samples=10, min_samples=5, max_cv=0.15, min_interval_ms=1000, max_interval_ms=3_600_000)
HEX = ["0f9c3a7be1d24856a9b0c7f3e2d18465", "9b1d7e3f5a2c4860d8e7f6a5b4c39210"]


def events(spark, rows):
    """rows: (kind, ms, source, more)"""
    from pyspark.sql import functions as F

    flat = [(k, ms, ip, m.get("dest"), m.get("action", "ALLOW"), m.get("ok"), m.get("query"), m.get("raw", str(i))) for i, (k, ms, ip, m) in enumerate(rows)]
    df = spark.createDataFrame(flat, "source_type string, ms long, source_ip string, dest_ip string, action string, auth_success boolean, dns_query string, raw string")
    df = df.withColumn("event_time", F.timestamp_millis("ms")).withColumn("dest_port", F.lit(443)).withColumn("user", F.lit("u")).withColumn("host", F.lit("h"))
    return df.select(*(c.split()[0] for c in EVENT.split(", ")))


def beacon(spark, offsets, rule=TEST_RULE, **more):
    rows = [("firewall", BASE + o, "10.0.6.200", {"dest": "198.51.100.77", **more}) for o in offsets]
    random.Random(len(offsets)).shuffle(rows)
    return sorted(detectors.beacon_alerts(events(spark, rows), rule).selectExpr("unix_millis(window_start) AS a", "unix_millis(window_end) AS b", "score").collect())


def test_regular_traffic_fires_once(spark):
    [r] = beacon(spark, FAR)
    assert (r.a, r.b) == (BASE - 29_975, BASE + 119_900)
    assert r.score == pytest.approx(0.983424, abs=1e-6)


@pytest.mark.parametrize(
    "offsets",
    [
        [0, 2000, 49_000, 54_000, 144_000, 156_000],  # irregular
        FAR[:4],  # too few
        [i * 900 for i in range(8)],  # too often
        [*range(0, 4 * 30_000, 30_000), *range(2_000_000, 2_000_000 + 4 * 30_000, 30_000)],  # two sessions of four
        [0] * 8,
        [],
    ],
)
def test_silent(spark, offsets):
    assert beacon(spark, offsets) == []


def test_denied_connections_dont_count(spark):
    assert beacon(spark, FAR, action="DENY") == []
    assert len(beacon(spark, FAR, action="allow")) == 1


def test_alerts_again_after_the_cooldown(spark):
    got = beacon(spark, [i * 30_000 for i in range(15)])
    assert [(r.b - BASE) // 30_000 for r in got] == [4, 7, 10, 13]


def test_only_the_last_samples_count(spark):
    rule = BeaconRule(max_samples=5, min_samples=5, min_interval_ms=1000)
    got = beacon(spark, [0, 1000, 90_000, 95_000, 100_000, 105_000, 110_000], rule)
    assert [r.b - BASE for r in got] == [110_000]


def logins(spark, rows, rule=LoginRule()):
    e = events(spark, [("auth", BASE // 300_000 * 300_000 + ms, "10.0.0.1", {"ok": ok}) for ms, ok in rows])
    return detectors.failed_login_alerts(detectors.failed_login_windows(e, rule), rule).collect()


def test_failed_logins(spark):
    assert logins(spark, [(i, False) for i in range(9)] + [(10, None), (11, True)]) == []
    [r] = logins(spark, [(i, False) for i in range(10)] + [(10, None)])
    assert r.score == pytest.approx(1 / 3)
    assert r.details == "10 failed logins (of 11 total auth events) from 10.0.0.1 in a 5-minute window (threshold=10)"
    assert logins(spark, [(i, False) for i in range(40)])[0].score == 1.0
    assert logins(spark, [(0, False)] * 5 + [(300_000, False)] * 5) == []


def dns(spark, times, queries, model=DnsModel()):
    e = events(spark, [("dns", BASE + t, "10.0.7.50", {"query": q}) for t, q in zip(times, queries)])
    return detectors.dns_alerts(detectors.dns_windows(e, model), model).collect()


def test_dns_tunnel(spark):
    tunnel = [f"{HEX[i % 2]}.{HEX[(i + 1) % 2]}.exfil.badhost.net" for i in range(20)]
    assert dns(spark, range(7), tunnel) == []
    [r] = dns(spark, range(0, 8000, 1000), tunnel)
    assert r.window_end.timestamp() - r.window_start.timestamp() == 60
    assert dns(spark, range(8), tunnel, DnsModel(2.0, 0.75)) == []
    assert dns(spark, range(8), tunnel, DnsModel(2.0, 0.0)) == []
    assert dns(spark, range(8), tunnel, DnsModel(0.0, 0.1))[0].score == 1.0
    assert dns(spark, [0] * 4 + [60_000] * 4, tunnel) == []  # the second four open a window
    assert dns(spark, range(8), ["www.example.com"] * 8) == []
    assert dns(spark, range(9), [None, *tunnel]) != []


def test_order_of_rows_is_irrelevant(spark):
    rng = random.Random(4)
    rows = [("firewall", BASE + i * 30_000 + rng.randrange(2000), "a", {"dest": "b"}) for i in range(40)]
    rows += [("dns", BASE + i * 3000, "c", {"query": f"{HEX[i % 2]}.x.y.z"}) for i in range(60)]
    rows += [("auth", BASE + i * 9000, "d", {"ok": i % 3 == 0}) for i in range(80)]
    rows = [(k, ms, ip, m | {"raw": str(i)}) for i, (k, ms, ip, m) in enumerate(rows)]
    first = sorted(map(repr, detectors.all_alerts(events(spark, rows)).collect()))
    rng.shuffle(rows)
    assert first == sorted(map(repr, detectors.all_alerts(events(spark, rows).repartition(7)).collect()))
    assert len(first) > 3


def test_picked_keeps_its_place_across_batches(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.randrange(1, 50)) for k in "abc" for t in sorted(rng.sample(range(5000), 700))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    got = {(r.k, r.t): r.picked for r in picked(spark.createDataFrame(rows, "k string, t long, need long"), ["k"], "t", "need").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    last = {}
    for k, t, need in rows:
        pick = k not in last or t - last[k] >= need
        assert got[k, t] == pick
        if pick:
            last[k] = t


def test_training(spark):
    with pytest.raises(ValueError, match="99 queries"):
        training.train(spark.createDataFrame([("a.b.c",)] * 99, "dns_query string"))
    model = training.train(spark.createDataFrame([("ab.x.y",)] * 100, "dns_query string"))
    assert (model.baseline_mean, model.baseline_std) == (1.0, 0.0)
    names = ["a.x.y"] * 30 + ["ab.x.y"] * 40 + ["abcd.x.y"] * 31
    model = training.train(spark.createDataFrame([(n,) for n in names], "dns_query string"))
    assert (model.baseline_mean, model.baseline_std) == (1.0, 1.4826)


def test_model_file(tmp_path):
    path = str(tmp_path / "m.json")
    DnsModel(2.123456, 0.5, 2.5, 9, 1000).save(path)
    assert DnsModel.load(path) == DnsModel(2.1235, 0.5, 2.5, 9, 1000)
    assert DnsModel.load(None) == DnsModel()
    (tmp_path / "bad.json").write_text(json.dumps({"baselineMeanEntropy": 1}))
    with pytest.raises(ValueError, match="fields"):
        DnsModel.load(str(tmp_path / "bad.json"))


def test_settings(monkeypatch):
    monkeypatch.setenv("PALISADE_SOURCE", "/in")
    job = Job.parse(["--login-threshold", "4", "--max-files-per-trigger", "7"])
    assert (job.source, job.login.threshold, job.max_files_per_trigger) == ("/in", 4, 7)
    assert duration_ms("1m30.5s") == 90_500
    with pytest.raises(ValueError, match="duration"):
        duration_ms("soon")
    good = {"sources": [{"type": "tail", "source_type": "dns", "path": "/x"}], "max_retries": 0, "required_acks": 0}
    assert ShipperConfig.from_dict(good).max_retries == 0
    for bad in ({"sources": []}, good | {"queue": 1}, good | {"batch_size": 0}, {"sources": [{"type": "tail", "source_type": "dns"}]}, {"sources": [{"type": "ftp"}]}):
        with pytest.raises(ValueError):  # noqa: PT011
            ShipperConfig.from_dict(bad)


def test_report(spark):
    rows = [(0, "t", "10.0.7.50", None, 0.5001, "x"), (1, "t", "10.0.7.50", None, 0.5004, "x"), (2, "t", "b", None, 0.9, "x")]
    df = spark.createDataFrame(rows, "pos int, alert_type string, source_ip string, dest_ip string, score double, details string")
    assert [r.pos for r in report.first_of_each(df, "pos").orderBy("pos").collect()] == [0, 2]
    assert [r.pos for r in report.top(df, "pos", 2).collect()] == [2, 1]
    assert [r.planted for r in report.planted(df).orderBy("pos").collect()] == [True, True, False]
    said = json.loads(report.summary_json(events(spark, [("dns", BASE, "a", {"query": "q"})]), df))
    assert said == {"events": {"dns": 1}, "alerts_by_type": {"t": 3}}


def test_alert_message(spark):
    rows = [("auth", BASE, "a", {"ok": False}) for _ in range(10)]
    [r] = detectors.alert_json(detectors.all_alerts(events(spark, rows))).collect()
    said = json.loads(r.value)
    assert list(said) == ["alertType", "detectedAtMillis", "windowStartMillis", "windowEndMillis", "sourceIp", "destIp", "score", "details", "sourceType"]
    assert said["destIp"] is None
