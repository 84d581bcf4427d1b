"""The streaming job: feed -> events, dead letters, late events, alerts, rollup."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from palisade.config import DnsModel, Job, LoginRule
from palisade.functions.scalars import average_subdomain_entropy, capped
from palisade.operators import parse
from palisade.operators.detectors import alert, alert_json
from palisade.plans.store import remove
from palisade.plans.warehouse import MONTHS, month, rollup_partials
from palisade.schemas import ALERT, EVENT, names
from palisade.sources import files
from palisade.streaming.processors import KEY, PACKED, WATCHED, WRITTEN, Detectors, packed
from palisade.workers import findable

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> None:
    for k, v in STATE.items():
        spark.conf.set(k, v)


def watched(events: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """What each detector watches (WATCHED). All source types share one watermark, firewall denials too.

    The time that carries the watermark is left out, else Spark would drop late rows before the detectors see them."""
    marked = events.withWatermark("event_time", delay)
    ms = F.unix_millis("event_time")
    detector = F.when(F.col("source_type") == "auth", "login").when((F.col("source_type") == "dns") & F.col("dns_query").isNotNull(), "dns").when((F.col("source_type") == "firewall") & (F.upper("action") == "ALLOW"), "beacon")
    columns = {"detector": detector, "dest_ip": F.when(detector == "beacon", F.col("dest_ip")).otherwise(F.lit("")), "event_ms": ms}
    failed = F.coalesce(~F.col("auth_success"), F.lit(False)).cast("double")
    columns |= {"value": F.when(detector == "login", failed).when(detector == "dns", average_subdomain_entropy(F.col("dns_query"))).otherwise(0.0)}
    columns |= {"detail": F.when(detector == "login", F.col("raw")).when(detector == "dns", F.col("dns_query"))}
    rows = marked.select(*(columns.get(n, F.col(n)).alias(n) for n in names(WATCHED)))
    # one condition with the time in it: a filter on other columns would move below the watermark
    return rows.filter("CASE WHEN event_ms IS NOT NULL THEN detector IS NOT NULL ELSE false END")


def detected(events: DataFrame, detectors: Detectors | None = None, delay: str = "30 seconds") -> DataFrame:
    """Alerts and late auth events (WRITTEN) of a stream of events."""
    findable(events.sparkSession)
    rows = watched(events, delay).mapInArrow(packed, PACKED).groupBy(*KEY)
    return rows.transformWithState(statefulProcessor=detectors or Detectors(), outputStructType=WRITTEN, outputMode="Append", timeMode="EventTime")


def failed_logins(events: DataFrame, rule: LoginRule = LoginRule(), delay: str = "60 seconds") -> DataFrame:  # noqa: B008
    """Detector 1 by Spark's own window aggregate: one row when a window and its lateness (in the delay) are over; late rows are dropped."""
    w = F.window("event_time", f"{rule.window_ms} milliseconds")
    got = events.withWatermark("event_time", delay).filter("CASE WHEN event_time IS NOT NULL THEN source_type = 'auth' ELSE false END").groupBy("source_ip", w.alias("w")).agg(F.count_if(~F.col("auth_success")).alias("failed"), F.count("*").alias("total"))
    said = F.format_string(f"%d failed logins (of %d total auth events) from %s in a {rule.window_ms // 60_000}-minute window (threshold={rule.threshold})", "failed", "total", "source_ip")
    return got.filter(F.col("failed") >= rule.threshold).select(
        *alert(
            alert_type=F.lit("failed_login_rate"), detected_at=F.col("w.end"), window_start=F.col("w.start"), window_end=F.col("w.end"), source_type=F.lit("auth"),
            source_ip=F.col("source_ip"), score=capped(F.col("failed") / (rule.threshold * 3)), details=said,
        )
    )


def routed(feed: DataFrame, job: Job, year: int | None = None) -> DataFrame:
    """One stream of kind (event, dead, late, alert) with an event, an alert or a message."""
    d = parse.decoded(feed, year)
    al = F.struct(*(F.col(n) for n in names(ALERT)))
    none = lambda s: F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ': ', 1) for c in s.split(', '))}>")
    whole = F.struct(*(c.alias(n) for n, c in parse.event_columns().items()))
    plain = d.select(F.when(F.col("event").isNotNull(), "event").otherwise("dead").alias("kind"), F.when(F.col("event").isNotNull(), whole).alias("event"), none(ALERT).alias("alert"), F.col("error").alias("message"))
    found = detected(parse.events(d), Detectors(job.login, job.beacon, DnsModel.load(job.model or None)), job.watermark)
    return plain.unionByName(found.select("kind", none(EVENT).alias("event"), F.when(F.col("kind") == "alert", al).alias("alert"), "message"))


def by_month(rows: DataFrame, path: str, time: str, number: int) -> None:
    """A batch's rows below their months (as the warehouse's readers and its ``expire`` take them) and batch_id=...; what an earlier try
    of the batch has left goes first, in whatever month, so that each row counts once."""
    part = MONTHS[time]
    remove(rows.sparkSession, f"{path}/{part}=*/batch_id={number}")
    rows.withColumn(part, month(F.col(time))).withColumn("batch_id", F.lit(number)).write.mode("append").partitionBy(part, "batch_id").parquet(path)


def sink(job: Job) -> Callable[[DataFrame, int], None]:
    """Writes a batch, replacing what an earlier try of the same batch has left."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            to = lambda path: f"{path}/batch_id={number}"
            if job.events_out:
                by_month(rows.filter("kind = 'event'").select("event.*").drop("action").withColumn("ingested_at", F.current_timestamp()), job.events_out, "event_time", number)
            alerts = rows.filter("kind = 'alert'").select("alert.*")
            if job.alerts_out:
                by_month(alerts.withColumn("alert_id", F.expr("uuid()")), job.alerts_out, "detected_at", number)
                alert_json(alerts).write.mode("overwrite").text(to(f"{job.alerts_out}_json"))
            if job.rollup_out:
                rollup_partials(alerts).write.mode("overwrite").parquet(to(job.rollup_out))
            if job.dead_letters_out:
                rows.filter("kind IN ('dead', 'late')").select(F.col("message").alias("value")).write.mode("overwrite").text(to(job.dead_letters_out))
        finally:
            rows.unpersist()

    return write


def start(spark: SparkSession, job: Job, feed: DataFrame | None = None, year: int | None = None, available_now: bool = False) -> StreamingQuery:
    configure(spark)
    source = files.feed(spark, job.source, job.max_files_per_trigger) if feed is None else feed
    out = routed(source, job, year).writeStream.foreachBatch(sink(job)).outputMode("append").option("checkpointLocation", job.checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=job.trigger)).start()


def console(alerts: DataFrame) -> StreamingQuery:
    return alerts.select(F.concat(F.lit("ALERT "), F.to_json(F.struct("*"))).alias("value")).writeStream.format("console").option("truncate", "false").outputMode("append").start()


def to_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """value (and key) to a Kafka topic; needs Spark's Kafka connector."""
    return messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


class Metrics(StreamingQueryListener):
    """Counters of running queries, and whether they are well."""

    def __init__(self) -> None:
        self.values: dict[str, float] = {"rows_in": 0, "rows_out": 0, "rows_dropped_late": 0, "batches": 0, "failures": 0, "rows_per_second": 0.0}

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        p = event.progress
        self.values["rows_in"] += p.numInputRows
        self.values["rows_out"] += max(0, p.sink.numOutputRows)
        self.values["rows_dropped_late"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.values["batches"] += 1
        self.values["rows_per_second"] = p.processedRowsPerSecond

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        self.values["failures"] += event.exception is not None

    def healthy(self) -> bool:
        return not self.values["failures"]

    def text(self) -> str:
        """The counters, one a line."""
        return "".join(f"palisade_{k} {v}\n" for k, v in self.values.items())

    def json(self) -> str:
        return json.dumps(self.values)
