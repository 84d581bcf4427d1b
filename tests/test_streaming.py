import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from palisade.config import Job
from palisade.operators import detectors, parse
from palisade.plans import warehouse
from palisade.sources import synth
from palisade.streaming import pipeline
from tests.compare import TABLES

LAST = '{"source_type":"dns","host":"h","received_at":"x","raw":"2024-01-02T00:00:00Z queries: client 9.9.9.9#1: query: a.b IN"}'


def feed_files(folder, values, parts):
    os.makedirs(folder)
    for i in range(parts):
        own = values[i * len(values) // parts : (i + 1) * len(values) // parts]
        path = f"{folder}/{i}.txt"
        with open(path, "w") as f:
            f.write("\n".join([*own, *([LAST] if i == parts - 1 else [])]) + "\n")
        os.utime(path, (1e9 + i, 1e9 + i))


def job(root, **more):
    return Job(source=f"{root}/in", events_out=f"{root}/ev", alerts_out=f"{root}/al", rollup_out=f"{root}/ro", dead_letters_out=f"{root}/dl", checkpoint=f"{root}/ck", max_files_per_trigger=1, **more)


def run(spark, settings, metrics=None):
    if metrics:
        spark.streams.addListener(metrics)
    q = pipeline.start(spark, settings, year=synth.YEAR, available_now=True)
    q.awaitTermination(300)
    if metrics:
        spark.streams.removeListener(metrics)
    assert q.exception() is None


def test_stream_agrees_with_batch(spark, tmp_path):
    feed = synth.raw_feed(spark.read.parquet(f"{TABLES}/events.parquet").select("event_id", "user_id")).cache()
    feed_files(f"{tmp_path}/in", [r.value for r in feed.orderBy("seq").collect()], 3)
    metrics = pipeline.Metrics()
    run(spark, job(tmp_path), metrics)
    d = parse.decoded(feed, year=synth.YEAR)
    columns = ["alert_type", "window_start", "window_end", "source_type", "source_ip", "dest_ip", "details"]
    got = warehouse.read_alerts(spark, f"{tmp_path}/al")
    expected = detectors.all_alerts(parse.events(d))
    key = lambda df: sorted((repr(tuple(r[:-1])), round(r[-1], 9)) for r in df.select(*columns, "score").collect())
    assert key(got) == key(expected)
    assert len(key(got)) > 10
    assert {r.alert_type for r in got.collect()} == {"failed_login_rate", "beaconing", "dns_tunneling"}
    assert spark.read.parquet(f"{tmp_path}/ev").count() == parse.events(d).count() + 1
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/dl").collect()) == sorted(r.message for r in parse.dead_letters(d).collect())
    assert spark.read.parquet(f"{tmp_path}/ro").agg(F.sum("alert_count")).first()[0] == got.count()
    assert json.loads(spark.read.text(f"{tmp_path}/al_json").first().value)["alertType"]
    assert metrics.healthy()
    assert "palisade_failures 0" in metrics.text()


def auth(second, ok="Failed"):
    at = f"Jan  1 00:{second // 60:02}:{second % 60:02}"
    return json.dumps({"source_type": "auth", "host": "h", "received_at": None, "raw": f"{at} sshd[1]: {ok} password for bob from 10.0.0.1 port 1"})


def test_late_events_go_to_dead_letters(spark, tmp_path):
    """The watermark that a batch sees is that of the batches before it."""
    os.makedirs(f"{tmp_path}/in")
    batches = [[auth(i) for i in range(9)], [auth(700)], [auth(400)], [auth(5), auth(701), auth(650)], [auth(1500)], [LAST]]
    for i, rows in enumerate(batches):
        path = f"{tmp_path}/in/{i}.txt"
        with open(path, "w") as f:
            f.write("\n".join(rows) + "\n")
        os.utime(path, (1e9 + i, 1e9 + i))
    run(spark, job(tmp_path))
    late = [r.value for r in spark.read.text(f"{tmp_path}/dl").collect()]
    assert sorted(x.split(" sshd")[0] for x in late) == [f"late_auth_event: Jan  1 00:{t}" for t in ("00:05", "06:40")]
    assert warehouse.read_alerts(spark, f"{tmp_path}/al").count() == 0


def test_what_the_job_writes_expires_by_month(spark, tmp_path):
    path = str(tmp_path / "ev")
    rows = spark.sql("SELECT timestamp_millis(1704067200000 + id * 86400000) AS event_time, id FROM range(70)")
    for number in (0, 0, 1):  # batch 0 is tried twice
        pipeline.by_month(rows.filter(f"id % 2 = {number}"), path, "event_time", number)
    assert spark.read.parquet(path).count() == 70
    found = warehouse.between(spark.read.parquet(path), "event_time", datetime(2024, 3, 1))
    assert found.count() == 10
    assert "PartitionFilters: [isnotnull(event_month" in found._jdf.queryExecution().executedPlan().toString()
    assert warehouse.expire(spark, path, "event_month", datetime(2024, 5, 15), 90) == ["202401"]
    assert spark.read.parquet(path).count() == 39


def test_built_in_window_aggregate(spark, tmp_path):
    feed_files(f"{tmp_path}/in", [auth(i) for i in range(12)] + [auth(1000)], 2)
    d = parse.decoded(spark.readStream.option("maxFilesPerTrigger", 1).text(f"{tmp_path}/in"), year=synth.YEAR)
    q = pipeline.failed_logins(parse.events(d)).writeStream.format("memory").queryName("built_in").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    [r] = spark.sql("SELECT * FROM built_in").collect()
    assert r.details.startswith("12 failed logins (of 12")


def test_generated_feed(spark):
    assert synth.generated(spark, 600).count() > 600
