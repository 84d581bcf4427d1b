"""Schemas of the records; none is inferred."""

from __future__ import annotations

ENVELOPE = "source_type STRING, host STRING, received_at STRING, raw STRING"
EVENT = "source_type STRING, event_time TIMESTAMP, source_ip STRING, dest_ip STRING, dest_port INT, action STRING, user STRING, auth_success BOOLEAN, dns_query STRING, host STRING, raw STRING"
ALERT = "alert_type STRING, detected_at TIMESTAMP, window_start TIMESTAMP, window_end TIMESTAMP, source_type STRING, source_ip STRING, dest_ip STRING, score DOUBLE, details STRING"
ROLLUP = "hour TIMESTAMP, alert_type STRING, source_ip STRING, alert_count BIGINT, max_score DOUBLE"
DEAD_LETTER = "reason STRING, message STRING"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
