"""The registered queries, over the synthetic feed made from the driver's events; times are epoch milliseconds and scores are rounded.

Parsing reads the feed itself. It is decoded once into a table of events by month, which the detectors and analysts' queries read, and
their alerts once into a table of alerts; ``stream_`` queries read what the streaming job has made of the feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.config import DnsModel, Job
from palisade.functions.scalars import average_subdomain_entropy, from_millis, millis, shannon_entropy, shortened
from palisade.operators import detectors, parse, report, training
from palisade.plans import oracle as O
from palisade.plans import store
from palisade.plans import warehouse as W
from palisade.schemas import ALERT, ROLLUP
from palisade.sources import files, synth
from palisade.workers import spread

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.raw_feed(spread(_rows(spark, sf_dir)))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.decoded(feed(spark, sf_dir), year=synth.YEAR)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.events(decoded(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events, ingested up to 90 s after they happen."""

    def write(path: str) -> None:
        late = F.pmod(millis(F.col("event_time")).bitwiseXOR(F.lit(21845)), F.lit(90_000))
        W.write_events(parsed(spark, sf_dir), path, from_millis(millis(F.col("event_time")) + late), action=True)

    return W.read_events(spark, store.built(spark, "events", f"{sf_dir}/events.parquet", write), action=True)


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.all_alerts(events(spark, sf_dir))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored alerts."""
    return W.read_alerts(spark, store.built(spark, "alerts", f"{sf_dir}/events.parquet", lambda path: W.write_alerts(detected(spark, sf_dir), path)))


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def ms(c: str) -> Column:
    return millis(F.col(c)).alias(f"{c}_ms" if not c.endswith("_time") else c.replace("_time", "_ms"))


FEED, EVENTS = [O.FEED], [O.FEED, O.PARSED]
LOGINS, CHANNELS = [*EVENTS, O.FAILED], [*EVENTS, O.CONNECTIONS]
NAMES = [*EVENTS, O.ENTROPY]
WINDOWS = [*NAMES, O.DNS_WINDOWS]
ALERTS = O.all_alerts()
ALERT_COLUMNS = "alert_type, window_start_ms, window_end_ms, source_type, source_ip, dest_ip, score"


def told(alerts: DataFrame) -> DataFrame:
    """Alerts without wall clock and without text that rounds."""
    return alerts.select("alert_type", ms("window_start"), ms("window_end"), "source_type", "source_ip", "dest_ip", r6("score").alias("score"))


# Parsing


@query(O.query("SELECT seq, value FROM feed", *FEED))
def synthetic_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir)


def _parsed(kind: str, columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = parsed(spark, sf_dir).filter(F.col("source_type") == kind).withColumn("event_ms", millis(F.col("event_time")))
        return e.select(*columns.split(", "))

    run.__name__ = f"parse_{kind}"
    return query(O.query(f"SELECT {', '.join(f'"{c}"' for c in columns.split(', '))} FROM ev WHERE source_type = '{kind}'", *EVENTS))(run)


_parsed("auth", "event_ms, source_ip, user, auth_success, host")
_parsed("dns", "event_ms, source_ip, dns_query, host")
_parsed("firewall", "event_ms, source_ip, dest_ip, dest_port, action, host")


@query(O.query('SELECT source_type, event_ms, source_ip, dest_ip, dest_port, action, "user", auth_success, dns_query, host, raw FROM ev', *EVENTS))
def parse_dispatch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parsed(spark, sf_dir)
    return e.withColumn("event_ms", millis(F.col("event_time"))).drop("event_time")


@query(O.query("SELECT reason, message FROM dead", *EVENTS))
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.dead_letters(decoded(spark, sf_dir))


@query(O.query("SELECT source_type, count(*) AS events, count(*) FILTER (WHERE dest_port NOT BETWEEN 0 AND 65535) AS bad_ports FROM ev GROUP BY ALL", *EVENTS))
def port_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.quality_counts(events(spark, sf_dir))


@query(O.query("SELECT source_type, count(*) AS events FROM ev GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM ev", *EVENTS))
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts(events(spark, sf_dir))


# Failed logins


@query(O.query(f"SELECT {ALERT_COLUMNS} FROM la", *LOGINS))
def failed_login_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(detectors.failed_login_alerts(detectors.failed_login_windows(events(spark, sf_dir))))


@query(O.query("SELECT source_ip, window_ms, failed, total FROM lw", *LOGINS))
def failed_login_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.failed_login_windows(events(spark, sf_dir))


@query(
    O.query(
        "SELECT source_ip, window_ms, count(*) FILTER (WHERE NOT auth_success) AS failed, count(*) AS total, max(ms) AS last_ms FROM lq GROUP BY ALL",
        *EVENTS,
        "au AS (SELECT source_ip, event_ms AS ms, auth_success, seq FROM ev WHERE source_type = 'auth')",
        O.anchored("lq", "au", "source_ip", "ms, seq", 300_000),
    )
)
def failed_login_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.failed_login_anchored_windows(events(spark, sf_dir))


# Beaconing


@query(O.query("SELECT source_ip, dest_ip, ms, gap, session FROM c2", *CHANNELS))
def beacon_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.beacon_intervals(events(spark, sf_dir)).select("source_ip", "dest_ip", "ms", "gap", "session")


@query(O.query("SELECT source_ip, dest_ip, ms, samples, round(mean_ms, 4) AS mean_ms, round(sd_ms, 4) AS sd_ms FROM cv WHERE samples >= 5", *CHANNELS))
def beacon_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = detectors.beacon_cv(events(spark, sf_dir)).filter("samples >= 5")
    return got.select("source_ip", "dest_ip", "ms", "samples", F.round("mean_ms", 4).alias("mean_ms"), F.round("sd_ms", 4).alias("sd_ms"))


@query(O.query(f"SELECT {ALERT_COLUMNS} FROM ba", *CHANNELS, O.BEACONS))
def beacon_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(detectors.beacon_alerts(events(spark, sf_dir)))


# DNS tunneling


@query(O.query("SELECT source_ip, ms, dns_query, round(entropy, 6) AS entropy FROM de", *NAMES))
def dns_entropy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.dns_entropy(events(spark, sf_dir)).withColumn("entropy", r6("entropy"))


@query(
    """WITH h AS (SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host FROM pages),
    c AS (SELECT page_id, c, count(*) AS n, length(any_value(host)) AS l FROM (SELECT page_id, host, unnest(string_split(host, '')) AS c FROM h) GROUP BY page_id, c)
    SELECT page_id, round(sum(-(n / l) * log2(n / l)), 6) AS entropy FROM c GROUP BY page_id"""
)
def host_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/:?#]+)", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", r6(shannon_entropy(host)).alias("entropy"))


@query(O.query("SELECT source_ip, window_ms, queries, round(mean_entropy, 6) AS mean_entropy, last_query FROM dw", *WINDOWS))
def dns_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.dns_windows(events(spark, sf_dir)).withColumn("mean_entropy", r6("mean_entropy"))


@query(O.query(f"SELECT {ALERT_COLUMNS} FROM da", *WINDOWS, O.dns_alerts("2.0", "0.48")))
def dns_alerts_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(detectors.dns_alerts(detectors.dns_windows(events(spark, sf_dir))))


@query(O.query(f"SELECT {ALERT_COLUMNS} FROM da", *WINDOWS, O.BASELINE, O.dns_alerts("(SELECT round(median, 4) FROM base_model)", "(SELECT round(mad_std, 4) FROM base_model)")))
def dns_alerts_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return told(detectors.dns_alerts(detectors.dns_windows(e), baseline=training.trained(e.filter("source_type = 'dns'"))))


@query(O.query("SELECT queries, round(median, 6) AS median, round(mad_std, 6) AS mad_std, round(mean, 6) AS mean FROM base_model", *NAMES, O.BASELINE))
def dns_model_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = training.baseline(events(spark, sf_dir).filter("source_type = 'dns'"))
    return got.select("queries", r6("median").alias("median"), r6("mad_std").alias("mad_std"), r6("mean").alias("mean"))


# Alerts together


@query(O.query(f"SELECT {ALERT_COLUMNS} FROM alerts", *ALERTS))
def alert_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detectors themselves; the queries below read their stored alerts."""
    return told(detected(spark, sf_dir))


@query(
    O.query(
        """SELECT j ->> '$.alertType' AS alert_type, (j -> '$.windowStartMillis')::BIGINT AS window_start_ms, j ->> '$.destIp' AS dest_ip, len(json_keys(j)) AS n_fields
        FROM (SELECT to_json({'alertType': alert_type, 'detectedAtMillis': window_end_ms, 'windowStartMillis': window_start_ms, 'windowEndMillis': window_end_ms, 'sourceIp': source_ip, 'destIp': dest_ip,
              'score': score, 'details': '', 'sourceType': source_type}) AS j FROM alerts)""",
        *ALERTS,
    )
)
def alert_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = detectors.alert_json(alerts(spark, sf_dir))
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return j.select(get("alertType").alias("alert_type"), get("windowStartMillis").cast("long").alias("window_start_ms"), get("destIp").alias("dest_ip"), F.size(F.json_object_keys("value")).cast("long").alias("n_fields"))


@query(O.query("SELECT alert_type, count(*) AS alerts FROM alerts GROUP BY 1", *ALERTS))
def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(alerts(spark, sf_dir))


#: Alerts as a report lists them: numbered, twice, without their times.
_LISTED = "listed AS (SELECT row_number() OVER (ORDER BY alert_type, source_ip, dest_ip, window_start_ms, k) AS pos, alert_type, source_ip, dest_ip, score, alert_type || ' from ' || source_ip AS details FROM alerts, (VALUES (0), (1)) v(k))"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = told(alerts(spark, sf_dir)).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    # a report's list is short; its order is part of what is tested
    return rows.sparkSession.sql(
        """SELECT row_number() OVER (ORDER BY alert_type, source_ip, dest_ip NULLS LAST, window_start_ms, k) AS pos, alert_type, source_ip, dest_ip, score,
           concat(alert_type, ' from ', source_ip) AS details FROM {rows}""",
        rows=rows,
    )


@query(
    O.query("SELECT pos, alert_type, source_ip, dest_ip, score, details FROM listed QUALIFY row_number() OVER (PARTITION BY alert_type, source_ip, dest_ip, round(score, 3), details ORDER BY pos) = 1", *ALERTS, _LISTED)
)
def report_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.first_of_each(_listed(spark, sf_dir), "pos")


@query(
    O.query(
        "SELECT * FROM (SELECT pos, alert_type, source_ip, dest_ip, score, details FROM listed QUALIFY row_number() OVER (PARTITION BY alert_type, source_ip, dest_ip, round(score, 3), details ORDER BY pos) = 1) ORDER BY score DESC, pos LIMIT 18",
        *ALERTS,
        _LISTED,
    )
)
def report_top18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top(report_dedup(spark, sf_dir), "pos")


@query(O.query("SELECT alert_type, source_ip, window_start_ms, source_ip IN ('10.0.6.200', '10.0.6.201', '10.0.7.50') AS planted FROM alerts", *ALERTS))
def planted_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.planted(told(alerts(spark, sf_dir))).select("alert_type", "source_ip", "window_start_ms", "planted")


@query(O.query("SELECT alert_type, source_ip, window_start_ms, window_end_ms AS detected_ms FROM alerts ORDER BY window_end_ms", *ALERTS))
def alerts_by_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.by_detection(alerts(spark, sf_dir))
    return rows.select("alert_type", "source_ip", millis(F.col("window_start")).alias("window_start_ms"), millis(F.col("detected_at")).alias("detected_ms"))


_TSV = "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 7 = 0 THEN event_type || chr(9) || 'short' ELSE event_type || chr(9) || '10.0.0.' || user_id || chr(9) || '' || chr(9) || CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE (event_id % 100)::VARCHAR END || chr(9) || 'text' || chr(9) || 'more' END"


@query(
    f"""SELECT event_id, f[1] AS alert_type, f[2] AS source_ip, f[3] AS dest_ip, coalesce(TRY_CAST(f[4] AS DOUBLE), 0.0) AS score, f[5] AS details
    FROM (SELECT event_id, string_split(line, chr(9)) AS f, line FROM (SELECT event_id, {_TSV} AS line FROM events)) WHERE line <> '' AND len(f) >= 5"""
)
def tsv_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _TSV.replace("chr(9)", "'\\t'").replace("(event_id % 100)::VARCHAR", "cast(event_id % 100 AS STRING)")
    text = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{line} AS value")
    return files.alert_fields(text)


@query("SELECT event_id, CASE WHEN length(t) > 12 THEN t[1:9] || '...' ELSE t END AS label FROM (SELECT event_id, replace(event_type || chr(9) || user_id, chr(9), ' ') AS t FROM events)")
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", shortened(F.concat_ws("\t", "event_type", "user_id"), 12).alias("label"))


# The warehouse; as_of is the time of the last event

_AS_OF = "present AS (SELECT max(event_ms) AS now FROM ev)"


def _warehouse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored events, and one row with as_of."""
    e = events(spark, sf_dir)
    return e, e.agg(F.max("event_time").alias("as_of"))


def _as_of(frame: DataFrame) -> Column:
    """The one value of a frame, as a subquery of the plan: nothing runs while a query is built."""
    return frame.scalar()


@query(
    O.query(
        """SELECT source_ip, alert_type, count(*) AS alert_count, max(score) AS max_score, min(window_end_ms) AS first_ms, max(window_end_ms) AS last_ms FROM alerts
        WHERE window_end_ms >= (SELECT now FROM present) - 86400000 GROUP BY ALL ORDER BY alert_count DESC, source_ip, alert_type LIMIT 20""",
        *ALERTS,
        _AS_OF,
    )
)
def q1_noisy_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, now = _warehouse(spark, sf_dir)
    got = W.noisy_sources(alerts(spark, sf_dir).withColumn("score", r6("score")), _as_of(now))
    return got.select("source_ip", "alert_type", "alert_count", "max_score", millis(F.col("first_seen")).alias("first_ms"), millis(F.col("last_seen")).alias("last_ms"))


@query(
    O.query(
        """SELECT event_ms - event_ms % 300000 AS bucket_ms, count(*) FILTER (WHERE NOT auth_success) AS failed, count(*) FILTER (WHERE auth_success) AS succeeded
        FROM ev, present WHERE source_type = 'auth' AND source_ip = '10.0.2.14' AND event_ms >= now - 21600000 GROUP BY 1 ORDER BY 1""",
        *EVENTS,
        _AS_OF,
    )
)
def q2_logins_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, now = _warehouse(spark, sf_dir)
    return W.logins_over_time(e, "10.0.2.14", _as_of(now)).select(millis(F.col("bucket")).alias("bucket_ms"), "failed", "succeeded")


@query(O.query("SELECT event_ms, dest_ip, dest_port, raw FROM ev WHERE source_type = 'firewall' AND source_ip = '10.0.6.200' AND dest_ip = '198.51.100.77' ORDER BY event_ms, raw LIMIT 200", *EVENTS))
def q3_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.channel(events(spark, sf_dir), "10.0.6.200", "198.51.100.77").select(millis(F.col("event_time")).alias("event_ms"), "dest_ip", "dest_port", "raw")


@query(
    O.query(
        """SELECT source_ip, count(*) AS query_count, count(DISTINCT dns_query) AS distinct_queries, round_even(avg(strlen(dns_query)), 1) AS avg_query_len
        FROM ev, present WHERE source_type = 'dns' AND event_ms >= now - 3600000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
        *EVENTS,
        _AS_OF,
    )
)
def q4_dns_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, now = _warehouse(spark, sf_dir)
    return W.dns_volume(e, _as_of(now))


_PARTIALS = "partials AS (SELECT window_end_ms - window_end_ms % 3600000 AS hour_ms, alert_type, source_ip, count(*) AS alert_count, max(score) AS max_score FROM alerts GROUP BY ALL)"


def _partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rollup_partials(alerts(spark, sf_dir).withColumn("score", r6("score")))


@query(O.query("SELECT hour_ms, alert_type, source_ip, alert_count, max_score FROM partials", *ALERTS, _PARTIALS))
def rollup_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partials(spark, sf_dir).select(millis(F.col("hour")).alias("hour_ms"), "alert_type", "source_ip", "alert_count", "max_score")


@query(O.query("SELECT hour_ms, alert_type, sum(alert_count)::BIGINT AS alerts, max(max_score) AS peak_score FROM partials GROUP BY ALL", *ALERTS, _PARTIALS))
def rollup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials of two batches, merged."""
    a = alerts(spark, sf_dir).withColumn("score", r6("score"))
    even = F.pmod(millis(F.col("window_start")), F.lit(2)) == 0
    both = W.rollup_partials(a.filter(even)).unionByName(W.rollup_partials(a.filter(~even)))
    return W.rollup_merged(both).select(millis(F.col("hour")).alias("hour_ms"), "alert_type", "alerts", "peak_score")


@query(
    O.query(
        "SELECT hour_ms, alert_type, sum(alert_count)::BIGINT AS alerts, max(max_score) AS peak_score FROM partials, present WHERE hour_ms >= now - 604800000 GROUP BY ALL ORDER BY 1, 2",
        *ALERTS,
        _PARTIALS,
        _AS_OF,
    )
)
def q5_weekly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, now = _warehouse(spark, sf_dir)
    return W.weekly_rollup(_partials(spark, sf_dir), _as_of(now)).select(millis(F.col("hour")).alias("hour_ms"), "alert_type", "alerts", "peak_score")


_INGESTED = "ing AS (SELECT source_type, event_ms, event_ms + xor(event_ms, 21845) % 90000 AS ing_ms FROM ev)"


@query(
    O.query(
        """SELECT source_type, quantile_cont(ing_ms // 1000 - event_ms // 1000, 0.5)::DOUBLE AS p50_lag_seconds, quantile_cont(ing_ms // 1000 - event_ms // 1000, 0.99)::DOUBLE AS p99_lag_seconds
        FROM ing, present WHERE ing_ms >= now - 600000 GROUP BY 1""",
        *EVENTS,
        _AS_OF,
        _INGESTED,
    )
)
def q6_ingest_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, now = _warehouse(spark, sf_dir)
    return W.ingest_lag(e, _as_of(now))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 15 DAY > (SELECT max(ts) FROM events)")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retention of 15 days keeps, as the events span 30."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return W.unexpired(e, "ts", _as_of(e.agg(F.max("ts"))), 15).select("event_id")


@query(O.query("SELECT event_ms, source_type, source_ip, raw FROM ev ORDER BY event_ms DESC, host, source_ip, source_type, raw LIMIT 20", *EVENTS))
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(millis(F.col("event_time")).alias("event_ms"), "host", "source_ip", "source_type", "raw")
    return W.latest(e, "event_ms").select("event_ms", "source_type", "source_ip", "raw")


# Late events, as a plain function of batches

_BATCHES = "bat AS (SELECT seq // 4000 AS batch, event_ms - CASE WHEN seq % 97 = 0 THEN 400000 ELSE 0 END AS ms, source_ip, raw FROM ev WHERE source_type = 'auth')"


@query(
    O.query(
        """SELECT batch, b.ms AS event_ms, 'late_auth_event: ' || raw AS message FROM bat b JOIN seen USING (batch) WHERE wm IS NOT NULL AND b.ms - b.ms % 300000 + 300000 + 30000 <= wm""",
        *EVENTS,
        _BATCHES,
        "tops AS (SELECT batch, max(ms) AS top FROM bat GROUP BY 1)",
        "seen AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 30000 AS wm FROM tops)",
    )
)
def late_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auth events whose window was closed, its lateness over, before their batch came."""
    from palisade.streaming.late import late_auth_events

    d = decoded(spark, sf_dir)
    auth = d.filter("event IS NOT NULL AND kind = 'auth'")
    shift = F.when(F.col("seq") % 97 == 0, 400_000).otherwise(0)
    rows = auth.select((F.col("seq") / 4000).cast("long").alias("batch"), (millis(F.col("event.event_time")) - shift).alias("event_ms"), F.col("envelope.raw").alias("raw"))
    return late_auth_events(rows)


@query(
    """WITH l AS (SELECT doc_id, lang, string_split(lang || '.' || source || '.example.com.', '.')[1:2] AS ls FROM documents),
    c AS (SELECT doc_id, i, c, count(*) AS n, any_value(len_) AS len_ FROM (SELECT doc_id, i, length(ls[i]) AS len_, unnest(string_split(ls[i], '')) AS c FROM l, (VALUES (1), (2)) v(i)) GROUP BY ALL),
    h AS (SELECT doc_id, i, sum(-(n / len_) * log2(n / len_)) AS h FROM c GROUP BY ALL)
    SELECT doc_id, round(avg(h), 6) AS entropy FROM h GROUP BY 1"""
)
def subdomain_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a trailing dot, made of two columns."""
    name = F.concat_ws(".", "lang", "source", F.lit("example.com."))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", r6(average_subdomain_entropy(name)).alias("entropy"))


# The streaming job over the same feed, in batches

_CLOSING = "end"  # the host of an event a day after the others, which lets the watermark pass them
_CHUNKS, _FILES = 4, 8


def _arrived(spark: SparkSession, sf_dir: str) -> str:
    """The feed as files, in order of arrival: chunks one after the other, so that their times tell the order."""

    def write(path: str) -> None:
        rows = _rows(spark, sf_dir)
        first, last = rows.agg(F.min("event_id"), F.max("event_id")).first()
        if first is None:
            return synth.raw_feed(rows).select("value").write.text(path)
        ends = synth.raw_feed(rows.filter(F.col("event_id").isin(first, last))).agg(F.min("seq"), F.max("seq"))
        first, last = ends.first()
        step = (last - first) // _CHUNKS + 1
        for i in range(_CHUNKS):
            a, b = first + i * step, first + (i + 1) * step - 1
            own = synth.raw_feed(spread(rows.filter(F.col("event_id").between(a // synth.EACH, b // synth.EACH)))).filter(F.col("seq").between(a, b))
            own.select("value").repartition(_FILES).write.mode("append").text(path)
        at = f"date_format(timestamp'{synth.START}' + make_interval(0, 0, 0, 1, 0, 0, {last // 4}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
        line = f"concat({at}, ' DENY TCP src=10.0.0.1 dst=10.0.0.2 dport=1')"
        spark.range(1).selectExpr(f"""to_json(named_struct('source_type', 'firewall', 'host', '{_CLOSING}', 'received_at', '', 'raw', {line})) AS value""").write.mode("append").text(path)

    return store.built(spark, "arrived", f"{sf_dir}/events.parquet", write)


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of what the job writes."""

    def write(path: str) -> None:
        from palisade.streaming import pipeline

        job = Job(source=_arrived(spark, sf_dir), events_out=f"{path}/events", alerts_out=f"{path}/alerts", rollup_out=f"{path}/rollup", dead_letters_out=f"{path}/dead", checkpoint=f"{path}/checkpoint", max_files_per_trigger=_FILES)
        _finished(pipeline.start(spark, job, year=synth.YEAR, available_now=True))

    return store.built(spark, "streamed", f"{sf_dir}/events.parquet", write)


def _finished(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query(O.query('SELECT source_type, event_ms, source_ip, dest_ip, dest_port, "user", auth_success, dns_query, host, raw FROM ev', *EVENTS))
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = W.read_events(spark, f"{_streamed(spark, sf_dir)}/events").filter(F.col("host") != _CLOSING)
    return e.withColumn("event_ms", millis(F.col("event_time"))).drop("event_time", "ingested_at", "event_month")


@query(O.query(f"SELECT {ALERT_COLUMNS} FROM alerts", *ALERTS))
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(W.read_alerts(spark, f"{_streamed(spark, sf_dir)}/alerts"))


@query(O.query("SELECT alert_type, window_start_ms, source_ip, dest_ip FROM alerts", *ALERTS))
def stream_alert_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = spark.read.schema("value STRING").text(f"{_streamed(spark, sf_dir)}/alerts_json")
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return j.select(get("alertType").alias("alert_type"), get("windowStartMillis").cast("long").alias("window_start_ms"), get("sourceIp").alias("source_ip"), get("destIp").alias("dest_ip"))


@query(O.query("SELECT message FROM dead", *EVENTS))
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("value STRING").text(f"{_streamed(spark, sf_dir)}/dead").select(F.col("value").alias("message"))


@query(O.query("SELECT alert_type, source_ip, count(*) AS alerts, max(score) AS peak_score FROM alerts GROUP BY ALL", *ALERTS))
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials of all batches, merged; hours are those of the job's clock."""
    partials = spark.read.schema(ROLLUP).parquet(f"{_streamed(spark, sf_dir)}/rollup")
    return W.rollup_merged(partials, "alert_type", "source_ip").withColumn("peak_score", r6("peak_score"))


@query(O.query(f"SELECT {ALERT_COLUMNS} FROM la", *LOGINS))
def stream_failed_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector 1 as Spark's own window aggregate with a watermark."""

    def write(path: str) -> None:
        from palisade.streaming import pipeline

        pipeline.configure(spark)
        d = parse.decoded(files.feed(spark, _arrived(spark, sf_dir), _FILES), year=synth.YEAR)
        out = pipeline.failed_logins(parse.events(d)).writeStream.format("parquet").outputMode("append")
        _finished(out.option("path", f"{path}/alerts").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())

    return told(spark.read.schema(ALERT).parquet(f"{store.built(spark, 'windows', f'{sf_dir}/events.parquet', write)}/alerts"))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items() if sql is not None}


DEFAULT_MODEL = DnsModel()
