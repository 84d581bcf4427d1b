"""Which events come too late, as a plain function of numbered batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.config import LoginRule


def late_auth_events(rows: DataFrame, rule: LoginRule = LoginRule(), delay_ms: int = 30_000) -> DataFrame:  # noqa: B008
    """batch, event_ms, message of the rows (batch, event_ms, raw) whose window, with its lateness, ended at or before the
    watermark that the batches before had reached."""
    tops = rows.groupBy("batch").agg(F.max("event_ms").alias("top"))
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each batch
    reached = tops.select("batch", (F.max("top").over(w) - delay_ms).alias("watermark"))
    end = F.col("event_ms") - F.pmod("event_ms", F.lit(rule.window_ms)) + rule.window_ms
    late = rows.join(reached, "batch").filter(end + rule.allowed_lateness_ms <= F.col("watermark"))
    return late.select("batch", "event_ms", F.concat(F.lit("late_auth_event: "), "raw").alias("message"))
