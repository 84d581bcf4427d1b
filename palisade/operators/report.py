"""What a report of alerts shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: sources that the synthetic log plants.
PLANTED = ("10.0.6.200", "10.0.6.201", "10.0.7.50")


def first_of_each(alerts: DataFrame, position: str) -> DataFrame:
    """Of alerts that say the same, the first by position."""
    w = Window.partitionBy("alert_type", "source_ip", "dest_ip", F.round("score", 3), "details").orderBy(position)
    return alerts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top(alerts: DataFrame, position: str, n: int = 18) -> DataFrame:
    return alerts.orderBy(F.desc("score"), position).limit(n)


def planted(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("planted", F.col("source_ip").isin(*PLANTED))


def summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count("*").alias("alerts"))


def counts(events: DataFrame) -> DataFrame:
    """Events by source type, and in all (null)."""
    return events.groupBy("source_type").agg(F.count("*").alias("events")).unionByName(events.agg(F.lit(None).cast("string").alias("source_type"), F.count("*").alias("events")))


def summary_json(events: DataFrame, alerts: DataFrame) -> str:
    """The run's summary, for standard output."""
    one = lambda df, k, v: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v)))).alias("m"))
    a = one(summary(alerts), "alert_type", "alerts").withColumnRenamed("m", "alerts_by_type")
    e = one(counts(events).filter("source_type IS NOT NULL"), "source_type", "events").withColumnRenamed("m", "events")
    return e.crossJoin(a).select(F.to_json(F.struct("events", "alerts_by_type"))).first()[0]
