"""Warehouse tables as partitioned Parquet, their retention, the hourly rollup, and the analysts' queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.scalars import bucket, from_millis, seconds_between
from palisade.schemas import ALERT, EVENT

# Retention in days, and the text kept of a raw line by the compact layout.
EVENT_DAYS, ALERT_DAYS = 90, 365
RAW_CHARS = 500


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM")


#: The column that partitions a table, by the time it is the month of.
MONTHS = {"event_time": "event_month", "detected_at": "alert_month"}


def write_events(events: DataFrame, path: str, ingested_at: Column | None = None, mode: str = "append", action: bool = False) -> None:
    """Events by month, sorted so that Parquet's statistics skip other types, sources and times; action is kept if asked for."""
    rows = (events if action else events.drop("action")).withColumn("ingested_at", F.current_timestamp() if ingested_at is None else ingested_at).withColumn("event_month", month(F.col("event_time")))
    rows.sortWithinPartitions("event_month", "source_type", "source_ip", "event_time").write.mode(mode).partitionBy("event_month").parquet(path)


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    rows = alerts.withColumn("alert_id", F.expr("uuid()")).withColumn("alert_month", month(F.col("detected_at")))
    rows.sortWithinPartitions("alert_month", "alert_type", "source_ip", "detected_at").write.mode(mode).partitionBy("alert_month").parquet(path)


def read_events(spark: SparkSession, path: str, action: bool = False) -> DataFrame:
    """A table of events; without any, it is empty."""
    own = ", ".join(c for c in EVENT.split(", ") if action or c.split()[0] != "action")
    return spark.read.schema(f"{own}, ingested_at TIMESTAMP, event_month STRING").parquet(path).drop("batch_id")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """A table of alerts; without any, it is empty."""
    return spark.read.schema(f"{ALERT}, alert_id STRING, alert_month STRING").parquet(path).drop("batch_id")


def write_compact(events: DataFrame, path: str, host: str = "local", mode: str = "append") -> None:
    """The small layout: one host, raw lines cut, a day column."""
    events.drop("action").withColumn("raw", F.substring("raw", 1, RAW_CHARS)).withColumn("host", F.lit(host)).withColumn("event_date", F.to_date("event_time")).write.mode(mode).partitionBy("event_date").parquet(path)


def between(table: DataFrame, column: str, first: datetime, last: datetime | None = None) -> DataFrame:
    """Rows from a time on, up to another; the month column is filtered, too, so that partitions are pruned."""
    part = MONTHS.get(column)
    out = table.filter(F.col(column) >= F.lit(first))
    if part in table.columns:
        out = out.filter(F.col(part) >= first.strftime("%Y%m"))
    if last is not None:
        out = out.filter(F.col(column) <= F.lit(last))
        out = out.filter(F.col(part) <= last.strftime("%Y%m")) if part in table.columns else out
    return out


def since(table: DataFrame, column: str, first: Column) -> DataFrame:
    """Rows from a time on that the plan itself works out; of a table by months, those before aren't read."""
    out = table.filter(F.col(column) >= first)
    part = MONTHS.get(column)
    return out.filter(F.col(part) >= month(first)) if part in table.columns else out


def unexpired(table: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    """Rows that retention keeps; the column stands by itself, so that the filter can reach the scan."""
    return table.filter(F.col(column) > as_of - F.expr(f"INTERVAL {days} DAYS"))


def expire(spark: SparkSession, path: str, part: str, as_of: datetime, days: int) -> list[str]:
    """Delete the months that end before retention begins; returns them. Later rows are left to ``unexpired``."""
    first = datetime.fromordinal(as_of.toordinal() - days).strftime("%Y%m")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{part}=") and name.split("=")[1] < first:
            fs.delete(status.getPath(), True)
            gone.append(name.split("=")[1])
    return sorted(gone)


# The rollup


def rollup_partials(alerts: DataFrame) -> DataFrame:
    """Mergeable counts and maxima of one batch of alerts: hour, alert_type, source_ip, alert_count, max_score."""
    return alerts.groupBy(F.date_trunc("hour", "detected_at").alias("hour"), "alert_type", "source_ip").agg(F.count("*").alias("alert_count"), F.max("score").alias("max_score"))


def rollup_merged(partials: DataFrame, *keys: str) -> DataFrame:
    """Partials of any batches, merged to coarser keys."""
    return partials.groupBy(*(keys or ("hour", "alert_type"))).agg(F.sum("alert_count").alias("alerts"), F.max("max_score").alias("peak_score"))


# The analysts' queries; as_of stands for the present time


def noisy_sources(alerts: DataFrame, as_of: Column, n: int = 20) -> DataFrame:
    own = since(alerts, "detected_at", as_of - F.expr("INTERVAL 1 DAY"))
    got = own.groupBy("source_ip", "alert_type").agg(F.count("*").alias("alert_count"), F.max("score").alias("max_score"), F.min("detected_at").alias("first_seen"), F.max("detected_at").alias("last_seen"))
    return got.orderBy(F.desc("alert_count"), "source_ip", "alert_type").limit(n)


def logins_over_time(events: DataFrame, source_ip: str, as_of: Column) -> DataFrame:
    own = since(events, "event_time", as_of - F.expr("INTERVAL 6 HOURS")).filter((F.col("source_type") == "auth") & (F.col("source_ip") == source_ip))
    return own.groupBy(from_millis(bucket(F.col("event_time"), 300_000)).alias("bucket")).agg(F.count_if(~F.col("auth_success")).alias("failed"), F.count_if("auth_success").alias("succeeded")).orderBy("bucket")


def channel(events: DataFrame, source_ip: str, dest_ip: str, n: int = 200) -> DataFrame:
    own = events.filter((F.col("source_type") == "firewall") & (F.col("source_ip") == source_ip) & (F.col("dest_ip") == dest_ip))
    return own.select("event_time", "dest_ip", "dest_port", "raw").orderBy("event_time", "raw").limit(n)


def dns_volume(events: DataFrame, as_of: Column, n: int = 20) -> DataFrame:
    own = since(events, "event_time", as_of - F.expr("INTERVAL 1 HOUR")).filter("source_type = 'dns'")
    got = own.groupBy("source_ip").agg(F.count("*").alias("query_count"), F.countDistinct("dns_query").alias("distinct_queries"), F.bround(F.avg(F.octet_length("dns_query")), 1).alias("avg_query_len"))
    return got.orderBy(F.desc("query_count"), "source_ip").limit(n)


def weekly_rollup(partials: DataFrame, as_of: Column) -> DataFrame:
    return rollup_merged(partials.filter(F.col("hour") >= as_of - F.expr("INTERVAL 7 DAYS"))).orderBy("hour", "alert_type")


def ingest_lag(events: DataFrame, as_of: Column) -> DataFrame:
    lag = seconds_between(F.col("event_time"), F.col("ingested_at"))
    own = events.filter(F.col("ingested_at") >= as_of - F.expr("INTERVAL 10 MINUTES"))
    return own.groupBy("source_type").agg(F.percentile(lag, 0.5).alias("p50_lag_seconds"), F.percentile(lag, 0.99).alias("p99_lag_seconds"))


def by_detection(alerts: DataFrame) -> DataFrame:
    """All alerts in the order of their detection; the other columns settle ties. Spark sorts by ranges, in all tasks."""
    return alerts.orderBy("detected_at", *(c for c in alerts.columns if c != "detected_at"))


def latest(table: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The last rows by a time; the other columns settle ties."""
    return table.orderBy(F.desc(column), *(c for c in table.columns if c != column)).limit(n)
