from datetime import datetime

from pyspark.sql import functions as F

from palisade.plans import warehouse as W


def events(spark):
    return spark.sql(
        """SELECT 'auth' AS source_type, timestamp_millis(1704067200000 + id * 86400000) AS event_time, concat('10.0.0.', id % 3) AS source_ip, NULL AS dest_ip, 1 AS dest_port,
           NULL AS action, 'u' AS user, true AS auth_success, NULL AS dns_query, 'h' AS host, repeat('x', 900) AS raw FROM range(70)"""
    ).withColumns({c: F.col(c).cast("string") for c in ("dest_ip", "action", "dns_query")})


def test_events_by_month(spark, tmp_path):
    path = str(tmp_path / "ev")
    W.write_events(events(spark), path)
    got = spark.read.parquet(path)
    assert "action" not in got.columns
    assert got.count() == 70
    found = W.between(got, "event_time", datetime(2024, 3, 1))
    assert found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan
    assert "PushedFilters: [IsNotNull(event_time)" in plan
    assert W.expire(spark, path, "event_month", datetime(2024, 5, 15), 90) == ["202401"]
    assert spark.read.parquet(path).count() == 39


def test_compact(spark, tmp_path):
    W.write_compact(events(spark), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "c"))
    assert got.agg(F.max(F.length("raw"))).first()[0] == 500
    assert got.select("event_date").distinct().count() == 70


def test_retention(spark):
    kept = W.unexpired(events(spark), "event_time", F.lit(datetime(2024, 3, 31)), W.EVENT_DAYS)
    assert kept.agg(F.min("event_time")).first()[0] == datetime(2024, 1, 2)


def test_rollup_merges_like_one_batch(spark, tmp_path):
    a = spark.sql("SELECT timestamp_millis(1704067200000 + id * 600000) AS detected_at, 't' AS alert_type, 's' AS source_ip, id / 100 AS score, 'd' AS details FROM range(50)")
    whole = W.rollup_merged(W.rollup_partials(a))
    parts = [W.rollup_partials(a.filter(f"cast(score * 100 AS INT) % 3 = {i}")) for i in range(3)]
    merged = W.rollup_merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    W.write_alerts(a, str(tmp_path / "al"))
    got = spark.read.parquet(str(tmp_path / "al"))
    assert got.select("alert_id").distinct().count() == 50
    assert len(W.latest(got, "detected_at", 3).collect()) == 3
