"""The three detectors over finished data. Streaming ones that agree with them are in ``palisade.streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.config import BeaconRule, DnsModel, LoginRule
from palisade.functions.scalars import average_subdomain_entropy, bucket, capped, from_millis, millis, z_score
from palisade.operators.scan import anchored, picked
from palisade.schemas import ALERT, names


def alert(**columns: Column) -> list[Column]:
    kinds = dict(c.split() for c in ALERT.split(", "))
    return [columns.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names(ALERT)]


# Failed logins


def failed_login_windows(events: DataFrame, rule: LoginRule = LoginRule()) -> DataFrame:  # noqa: B008
    """source_ip, window_ms, failed, total of each epoch-aligned window. A null result is no failure, but counts."""
    auth = events.filter("source_type = 'auth'")
    return auth.groupBy("source_ip", bucket(F.col("event_time"), rule.window_ms).alias("window_ms")).agg(F.count_if(~F.col("auth_success")).alias("failed"), F.count("*").alias("total"))


def failed_login_anchored_windows(events: DataFrame, rule: LoginRule = LoginRule()) -> DataFrame:  # noqa: B008
    """The same for windows that begin with a source's first event outside the window before."""
    auth = events.filter("source_type = 'auth'").select("source_ip", millis(F.col("event_time")).alias("ms"), "auth_success")
    return anchored(auth, ["source_ip"], "ms", rule.window_ms).groupBy("source_ip", "window_ms").agg(F.count_if(~F.col("auth_success")).alias("failed"), F.count("*").alias("total"), F.max("ms").alias("last_ms"))


def failed_login_alerts(windows: DataFrame, rule: LoginRule = LoginRule()) -> DataFrame:  # noqa: B008
    end = F.col("last_ms") if "last_ms" in windows.columns else F.col("window_ms") + rule.window_ms
    said = F.format_string(f"%d failed logins (of %d total auth events) from %s in a {rule.window_ms // 60_000}-minute window (threshold={rule.threshold})", "failed", "total", "source_ip")
    hit = windows.filter(F.col("failed") >= rule.threshold)
    return hit.select(
        *alert(
            alert_type=F.lit("failed_login_rate"),
            detected_at=from_millis(end),
            window_start=from_millis(F.col("window_ms")),
            window_end=from_millis(end),
            source_type=F.lit("auth"),
            source_ip=F.col("source_ip"),
            score=capped(F.col("failed") / (rule.threshold * 3)),
            details=said,
        )
    )


# Beaconing

CHANNEL = ["source_ip", "dest_ip"]


def connections(events: DataFrame) -> DataFrame:
    """Allowed connections: source_ip, dest_ip, ms, raw."""
    own = events.filter((F.col("source_type") == "firewall") & (F.upper("action") == "ALLOW"))
    return own.select(*CHANNEL, millis(F.col("event_time")).alias("ms"), "raw")


def beacon_intervals(events: DataFrame, rule: BeaconRule = BeaconRule()) -> DataFrame:  # noqa: B008
    """Connections with the gap to the one before in their session, and the session's number; a long gap begins a new one."""
    w = Window.partitionBy(*CHANNEL).orderBy("ms", "raw")
    gap = F.col("ms") - F.lag("ms").over(w)
    rows = connections(events).withColumn("gap", gap)
    new = F.when(F.col("gap") > rule.session_gap_ms, 1).otherwise(0)
    rows = rows.withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("gap", F.when(F.col("gap") <= rule.session_gap_ms, F.col("gap")))


def beacon_cv(events: DataFrame, rule: BeaconRule = BeaconRule()) -> DataFrame:  # noqa: B008
    """Connections with samples, mean_ms, sd_ms and cv over the last samples of their session."""
    w = Window.partitionBy(*CHANNEL, "session").orderBy("ms", "raw")
    last = w.rowsBetween(-(rule.max_samples - 2), 0)
    rows = beacon_intervals(events, rule)
    rows = rows.withColumn("samples", F.least(F.row_number().over(w), F.lit(rule.max_samples)))
    rows = rows.withColumn("mean_ms", F.avg("gap").over(last)).withColumn("sd_ms", F.stddev_pop("gap").over(last))
    return rows.withColumn("cv", F.when(F.col("mean_ms") > 0, F.col("sd_ms") / F.col("mean_ms")).when(F.col("mean_ms").isNotNull(), F.lit(1.7976931348623157e308)))


def beacon_alerts(events: DataFrame, rule: BeaconRule = BeaconRule()) -> DataFrame:  # noqa: B008
    regular = (F.col("samples") >= rule.min_samples) & (F.col("cv") <= rule.max_cv) & F.col("mean_ms").between(rule.min_interval_ms, rule.max_interval_ms)
    rows = beacon_cv(events, rule).filter(regular).withColumn("cooldown", (F.col("mean_ms") * rule.cooldown_intervals).cast("long"))
    hit = picked(rows, [*CHANNEL, "session"], "ms", "cooldown", ["raw"]).filter("picked")
    said = F.format_string(
        f"%d outbound connections to %s at ~%.1fs intervals (coefficient of variation=%.3f, threshold={rule.max_cv:.3f})", F.col("samples"), F.col("dest_ip"), F.col("mean_ms") / 1000, F.col("cv")
    )
    return hit.select(
        *alert(
            alert_type=F.lit("beaconing"),
            detected_at=from_millis(F.col("ms")),
            window_start=from_millis(F.col("ms") - (F.col("mean_ms") * F.col("samples")).cast("long")),
            window_end=from_millis(F.col("ms")),
            source_type=F.lit("firewall"),
            source_ip=F.col("source_ip"),
            dest_ip=F.col("dest_ip"),
            score=capped(1 - F.col("cv")),
            details=said,
        )
    )


# DNS tunneling


def dns_entropy(events: DataFrame) -> DataFrame:
    """source_ip, ms, dns_query and its entropy."""
    own = events.filter("source_type = 'dns' AND dns_query IS NOT NULL")
    return own.select("source_ip", millis(F.col("event_time")).alias("ms"), "dns_query", average_subdomain_entropy(F.col("dns_query")).alias("entropy"))


def dns_windows(events: DataFrame, model: DnsModel = DnsModel()) -> DataFrame:  # noqa: B008
    """source_ip, window_ms, queries, mean_entropy, last_query of windows that begin with the first query outside the one before."""
    rows = anchored(dns_entropy(events), ["source_ip"], "ms", model.window_ms, ["dns_query"])
    last = F.max_by("dns_query", F.struct("ms", "dns_query")).alias("last_query")
    return rows.groupBy("source_ip", "window_ms").agg(F.count("*").alias("queries"), F.avg("entropy").alias("mean_entropy"), last)


def dns_alerts(windows: DataFrame, model: DnsModel = DnsModel(), baseline: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """baseline: one row (baseline_mean, baseline_std) instead of the model's, as ``training.trained`` gives it."""
    if baseline is None:
        based = windows.withColumns({"baseline_mean": F.lit(model.baseline_mean), "baseline_std": F.lit(model.baseline_std)})
    else:
        based = windows.crossJoin(F.broadcast(baseline))  # one row
    z = z_score(F.col("mean_entropy"), F.col("baseline_mean"), F.col("baseline_std"))
    hit = based.filter(F.col("queries") >= model.min_queries).withColumn("z", z).filter(F.col("z") >= model.z_threshold)
    end = from_millis(F.col("window_ms") + model.window_ms)
    said = F.format_string(
        f"%d DNS queries from %s, mean subdomain entropy %.2f bits/char (baseline %.2f +/- %.2f, z-score %.2f, threshold {model.z_threshold:.2f}). Example query: %s",
        "queries", "source_ip", "mean_entropy", "baseline_mean", "baseline_std", "z", "last_query",
    )
    return hit.select(
        *alert(
            alert_type=F.lit("dns_tunneling"),
            detected_at=end,
            window_start=from_millis(F.col("window_ms")),
            window_end=end,
            source_type=F.lit("dns"),
            source_ip=F.col("source_ip"),
            score=capped(F.col("z") / (model.z_threshold * 2)),
            details=said,
        )
    )


def all_alerts(events: DataFrame, model: DnsModel = DnsModel(), login: LoginRule = LoginRule(), beacon: BeaconRule = BeaconRule()) -> DataFrame:  # noqa: B008
    """The alerts of the three detectors."""
    return failed_login_alerts(failed_login_windows(events, login), login).unionByName(beacon_alerts(events, beacon)).unionByName(dns_alerts(dns_windows(events, model), model))


def alert_json(alerts: DataFrame) -> DataFrame:
    """value: each alert as JSON for a message bus, times in epoch milliseconds, nulls included."""
    # The names of the message's fields.
    ms = lambda c: millis(F.col(c))
    fields = {"alertType": F.col("alert_type"), "detectedAtMillis": ms("detected_at"), "windowStartMillis": ms("window_start"), "windowEndMillis": ms("window_end")}
    fields |= {"sourceIp": F.col("source_ip"), "destIp": F.col("dest_ip"), "score": F.col("score"), "details": F.col("details"), "sourceType": F.col("source_type")}
    return alerts.select(F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"}).alias("value"))
