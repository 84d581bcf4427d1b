"""The same in DuckDB's SQL, written by itself: the synthetic feed, parsing, detectors. Parts are CTEs to put together."""

from __future__ import annotations

from palisade.config import BeaconRule, DnsModel, LoginRule
from palisade.sources.synth import BENIGN, DOMAINS, USERS

LOGIN, BEACON, MODEL = LoginRule(), BeaconRule(), DnsModel()


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FEED = rf"""
base AS (SELECT event_id AS e, user_id AS u, TIMESTAMP '2024-01-01' + to_seconds(event_id) AS t,
                {_list(BENIGN)}[(user_id % 10 + 1)::INT] AS ip, {_list(USERS)}[(event_id % 8 + 1)::INT] AS usr FROM events),
usual AS (SELECT e, u, t, 0 AS k, CASE WHEN e % 20 < 8 THEN 'auth' WHEN e % 20 < 15 THEN 'dns' ELSE 'firewall' END AS kind,
  CASE WHEN e % 20 < 8 THEN strftime(t, '%b %-d %H:%M:%S') || ' sshd[' || (1000 + e % 9000) || ']: ' ||
            CASE WHEN (e * 7919) % 25 < 2 OR u % 10 = 3 THEN 'Failed password' ELSE 'Accepted publickey' END || ' for ' || usr || ' from ' || ip || ' port ' || (20000 + e % 40000) || ' ssh2'
       WHEN e % 20 < 15 THEN strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') || ' queries: client ' || ip || '#' || (1024 + e % 60000) || ': query: ' ||
            {_list(DOMAINS)}[((e // 3) % 6 + 1)::INT] || ' IN A + (10.0.0.53)'
       ELSE strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') || CASE WHEN e % 17 = 0 THEN ' DENY' ELSE ' ALLOW' END || ' TCP src=' || ip || ' dst=203.0.113.' || (e % 7 + 1) || ' dport=443' END AS raw FROM base),
beacons AS (SELECT e, u, t, k + 1 AS k, 'firewall' AS kind,
  strftime(t + to_milliseconds((e // 30 * 7919 + k * 613) % 3000 - 1500), '%Y-%m-%dT%H:%M:%S.%gZ') || ' ALLOW TCP src=10.0.6.20' || k || ' dst=198.51.100.77 dport=443' AS raw
  FROM base, (VALUES (0), (1)) v(k) WHERE e % 30 = 0),
tunnels AS (SELECT e, u, t, 3 AS k, 'dns' AS kind, strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') || ' queries: client 10.0.7.50#' || (1024 + e % 60000) || ': query: ' ||
  md5(e::VARCHAR) || '.' || md5((e + 1)::VARCHAR) || '.exfil.badhost.net IN A + (10.0.0.53)' AS raw FROM base WHERE e % 5 = 3),
feed AS (SELECT e * 4 + k AS seq, CASE WHEN k = 0 AND e % 107 = 0 THEN 'not json ' || e ELSE '{{"source_type":"' || CASE WHEN k = 0 AND e % 103 = 0 THEN 'http' ELSE kind END ||
  '","host":"h' || (u % 4) || '","received_at":"' || strftime(t + to_milliseconds(1500), '%Y-%m-%dT%H:%M:%S.%gZ') || '","raw":"' || CASE WHEN k = 0 AND e % 101 = 0 THEN 'garbage ' || e ELSE raw END || '"}}' END AS value
  FROM (SELECT * FROM usual UNION ALL SELECT * FROM beacons UNION ALL SELECT * FROM tunnels))
"""

_IP = "[0-9a-fA-F.:]+"
PARSED = rf"""
env AS (SELECT seq, value, json_valid(value) AS valid, CASE WHEN json_valid(value) THEN value END AS j FROM feed),
fields AS (SELECT seq, value, valid, j ->> '$.source_type' AS kind, j ->> '$.host' AS host, j ->> '$.received_at' AS received_at, j ->> '$.raw' AS raw FROM env),
a AS (SELECT *, regexp_extract(raw, '^(\w{{3}}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}})\s+sshd\[\d+\]:\s+(Accepted|Failed)\s+\S+\s+for\s+(\S+)\s+from\s+({_IP})\s+port\s+\d+', ['ts', 'res', 'usr', 'ip']) AS m FROM fields WHERE kind = 'auth'),
d AS (SELECT *, regexp_extract(raw, '^(\S+)\s+queries:\s+client\s+({_IP})#\d+:\s+query:\s+(\S+)\s+IN', ['ts', 'ip', 'q']) AS m FROM fields WHERE kind = 'dns'),
f AS (SELECT *, regexp_extract(raw, '^(\S+)\s+(ALLOW|DENY)\s+\S+\s+src=({_IP})\s+dst=({_IP})\s+dport=(\d+)', ['ts', 'act', 'src', 'dst', 'port']) AS m FROM fields WHERE kind = 'firewall'),
tried AS (
  SELECT seq, value, kind, host, raw, epoch_ms(try_strptime('2024 ' || regexp_replace(m.ts, '\s+', ' ', 'g'), '%Y %b %d %H:%M:%S')) AS ms, m.ip AS source_ip, NULL::VARCHAR AS dest_ip, NULL::INT AS dest_port, NULL::VARCHAR AS action, m.usr AS usr, m.res = 'Accepted' AS ok, NULL::VARCHAR AS q FROM a
  UNION ALL SELECT seq, value, kind, host, raw, epoch_ms(try_strptime(m.ts, '%Y-%m-%dT%H:%M:%S.%gZ')), m.ip, NULL, NULL, NULL, NULL, NULL, m.q FROM d
  UNION ALL SELECT seq, value, kind, host, raw, epoch_ms(try_strptime(m.ts, '%Y-%m-%dT%H:%M:%S.%gZ')), m.src, m.dst, TRY_CAST(m.port AS INT), m.act, NULL, NULL, NULL FROM f),
ev AS (SELECT seq, kind AS source_type, ms AS event_ms, source_ip, dest_ip, dest_port, action, usr AS "user", ok AS auth_success, q AS dns_query, host, raw FROM tried WHERE ms IS NOT NULL AND source_ip <> ''),
dead AS (SELECT seq, 'json_decode_error' AS reason, 'json_decode_error: ' || value AS message FROM fields WHERE NOT valid
  UNION ALL SELECT seq, 'unknown_source_type', 'unknown_source_type(' || kind || '): ' || value FROM fields WHERE valid AND kind NOT IN ('auth', 'dns', 'firewall')
  UNION ALL SELECT seq, 'parse_error', 'parse_error(' || kind || '): ' || value FROM fields WHERE kind IN ('auth', 'dns', 'firewall') AND seq NOT IN (SELECT seq FROM ev))
"""


def anchored(name: str, rows: str, keys: str, order: str, size: int) -> str:
    """{name}: the rows of ``rows`` (with ms) and window_ms, windows that begin with the first row outside the one before."""
    return f"""
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {rows}),
{name}_r AS (SELECT *, ms AS window_ms FROM {name}_n WHERE rn = 1 UNION ALL
  SELECT n.*, CASE WHEN n.ms >= r.window_ms + {size} THEN n.ms ELSE r.window_ms END FROM {name}_r r JOIN {name}_n n USING ({keys}) WHERE n.rn = r.rn + 1),
{name} AS (SELECT * FROM {name}_r)"""


FAILED = f"""
lw AS (SELECT source_ip, event_ms - event_ms % {LOGIN.window_ms} AS window_ms, count(*) FILTER (WHERE NOT auth_success) AS failed, count(*) AS total FROM ev WHERE source_type = 'auth' GROUP BY ALL),
la AS (SELECT 'failed_login_rate' AS alert_type, window_ms AS window_start_ms, window_ms + {LOGIN.window_ms} AS window_end_ms, 'auth' AS source_type, source_ip, NULL::VARCHAR AS dest_ip,
  round(least(1, failed / {LOGIN.threshold * 3}), 6) AS score FROM lw WHERE failed >= {LOGIN.threshold})
"""

CONNECTIONS = f"""
c0 AS (SELECT source_ip, dest_ip, event_ms AS ms, raw FROM ev WHERE source_type = 'firewall' AND upper(action) = 'ALLOW'),
c1 AS (SELECT *, ms - lag(ms) OVER w AS g FROM c0 WINDOW w AS (PARTITION BY source_ip, dest_ip ORDER BY ms, raw)),
c2 AS (SELECT * EXCLUDE (g), CASE WHEN g <= {BEACON.session_gap_ms} THEN g END AS gap, (sum(CASE WHEN g > {BEACON.session_gap_ms} THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip, dest_ip ORDER BY ms, raw ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM c1),
c3 AS (SELECT *, least(row_number() OVER w, {BEACON.max_samples}) AS samples, avg(gap) OVER last AS mean_ms, stddev_pop(gap) OVER last AS sd_ms FROM c2
  WINDOW w AS (PARTITION BY source_ip, dest_ip, session ORDER BY ms, raw), last AS (PARTITION BY source_ip, dest_ip, session ORDER BY ms, raw ROWS BETWEEN {BEACON.max_samples - 2} PRECEDING AND CURRENT ROW)),
cv AS (SELECT *, CASE WHEN mean_ms > 0 THEN sd_ms / mean_ms END AS cv FROM c3)
"""

BEACONS = f"""
cand AS (SELECT *, trunc(mean_ms * 3)::BIGINT AS cooldown, row_number() OVER (PARTITION BY source_ip, dest_ip, session ORDER BY ms, raw) AS rn FROM cv
  WHERE samples >= {BEACON.min_samples} AND cv <= {BEACON.max_cv} AND mean_ms BETWEEN {BEACON.min_interval_ms} AND {BEACON.max_interval_ms}),
fold AS (SELECT *, ms AS last, true AS hit FROM cand WHERE rn = 1 UNION ALL
  SELECT n.*, CASE WHEN n.ms - r.last >= n.cooldown THEN n.ms ELSE r.last END, n.ms - r.last >= n.cooldown FROM fold r JOIN cand n USING (source_ip, dest_ip, session) WHERE n.rn = r.rn + 1),
ba AS (SELECT 'beaconing' AS alert_type, ms - trunc(mean_ms * samples)::BIGINT AS window_start_ms, ms AS window_end_ms, 'firewall' AS source_type, source_ip, dest_ip, round(greatest(0, 1 - cv), 6) AS score FROM fold WHERE hit)
"""

ENTROPY = """
names AS (SELECT DISTINCT dns_query AS q FROM ev WHERE source_type = 'dns' AND dns_query IS NOT NULL),
labels AS (SELECT q, string_split(regexp_replace(q, '\\.+$', ''), '.') AS ls FROM names),
own AS (SELECT q, unnest(CASE WHEN len(ls) <= 2 THEN ls[1:1] ELSE ls[1:len(ls) - 2] END) AS label, unnest(range(CASE WHEN len(ls) <= 2 THEN 1 ELSE len(ls) - 2 END)) AS i FROM labels),
chars AS (SELECT q, i, c, count(*) AS n, length(any_value(label)) AS l FROM (SELECT q, i, label, unnest(string_split(label, '')) AS c FROM own) GROUP BY q, i, c),
bits AS (SELECT q, i, sum(-(n / l) * log2(n / l)) AS h FROM chars GROUP BY q, i),
entropy AS (SELECT q, avg(h) AS entropy FROM bits GROUP BY q),
de AS (SELECT source_ip, event_ms AS ms, dns_query, entropy FROM ev JOIN entropy ON dns_query = q WHERE source_type = 'dns')
"""

DNS_WINDOWS = anchored("dq", "de", "source_ip", "ms, dns_query", MODEL.window_ms) + """,
dw AS (SELECT source_ip, window_ms, count(*) AS queries, avg(entropy) AS mean_entropy, arg_max(dns_query, (ms, dns_query)) AS last_query FROM dq GROUP BY ALL)
"""

BASELINE = """
med AS (SELECT count(*) AS queries, median(entropy) AS median, avg(entropy) AS mean FROM de),
base_model AS (SELECT any_value(queries) AS queries, any_value(m.median) AS median, any_value(mean) AS mean, median(abs(entropy - m.median)) * 1.4826 AS mad_std FROM de, med m)
"""


def dns_alerts(mean: str, std: str, name: str = "da") -> str:
    """Alerts {name} for a baseline; a standard deviation of 0 gives none."""
    z = f"CASE WHEN {std} > 0 THEN (mean_entropy - {mean}) / {std} ELSE 0 END"
    return f"""
{name} AS (SELECT 'dns_tunneling' AS alert_type, window_ms AS window_start_ms, window_ms + {MODEL.window_ms} AS window_end_ms, 'dns' AS source_type, source_ip, NULL::VARCHAR AS dest_ip,
  round(least(1, z / {MODEL.z_threshold * 2}), 6) AS score FROM (SELECT *, {z} AS z FROM dw) WHERE queries >= {MODEL.min_queries} AND z >= {MODEL.z_threshold})
"""


ALERTS = "alerts AS (SELECT * FROM la UNION ALL SELECT * FROM ba UNION ALL SELECT * FROM da)"


def query(select: str, *parts: str, recursive: bool = True) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(p.strip() for p in parts)} {select}"


def all_alerts() -> list[str]:
    return [FEED, PARSED, FAILED, CONNECTIONS, BEACONS, ENTROPY, DNS_WINDOWS, dns_alerts(str(MODEL.baseline_mean), str(MODEL.baseline_std)), ALERTS]
