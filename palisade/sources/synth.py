"""A synthetic log, the same for the same rows: envelopes of a raw feed from a table of events (event_id, user_id).

An event's number gives its second, its source type (8 auth, 7 dns, 5 firewall of 20), and its fields. Planted are two
beacons of about 30 s, a tunnel, an address that mostly fails to log in, and lines that can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Addresses, users and domains of the log.
BENIGN = ("10.0.1.12", "10.0.1.45", "10.0.1.88", "10.0.2.14", "10.0.2.77", "10.0.3.5", "10.0.3.61", "10.0.4.23", "10.0.4.99", "10.0.5.31")
USERS = ("alice", "bob", "carol", "dave", "erin", "frank", "svc-backup", "svc-monitor")
DOMAINS = ("example.com", "internal.corp", "api.example.com", "cdn.example.net", "mail.example.com", "vpn.example.com")

START = "2024-01-01 00:00:00"
YEAR = 2024
#: An event's envelopes have the numbers from EACH times its own on.
EACH = 4

#: (kind, condition, milliseconds after the event's second, raw line) in SQL that Spark reads; {at} and {iso} are the times.
_AUTH = "concat(date_format({at}, 'MMM d HH:mm:ss'), ' sshd[', 1000 + e % 9000, ']: ', if({fail}, 'Failed password', 'Accepted publickey'), ' for ', {user}, ' from ', {ip}, ' port ', 20000 + e % 40000, ' ssh2')"
_FAIL = "((e * 7919) % 25 < 2 OR u % 10 = 3)"


def _pick(values: tuple[str, ...], n: str) -> str:
    return f"element_at(array({', '.join(map(repr, values))}), cast({n} % {len(values)} AS INT) + 1)"


def raw_feed(events: DataFrame) -> DataFrame:
    """seq and value: the feed's envelopes as JSON, seq in order of arrival."""
    iso = "date_format({at}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    t = f"timestamp'{START}' + make_interval(0, 0, 0, 0, 0, 0, e)"
    jitter = "((e DIV 30 * 7919 + {k} * 613) % 3000 - 1500) / 1000"
    ip, user = _pick(BENIGN, "u"), _pick(USERS, "e")
    auth = _AUTH.format(at="t", fail=_FAIL, user=user, ip=ip)
    dns = "concat({iso}, ' queries: client ', {ip}, '#', 1024 + e % 60000, ': query: ', {name}, ' IN A + (10.0.0.53)')"
    fw = "concat({iso}, ' ', {action}, ' TCP src=', {ip}, ' dst=', {dst}, ' dport=443')"
    usual = f"""CASE WHEN e % 20 < 8 THEN {auth}
        WHEN e % 20 < 15 THEN {dns.format(iso=iso.format(at="t"), ip=ip, name=_pick(DOMAINS, "e DIV 3"))}
        ELSE {fw.format(iso=iso.format(at="t"), action="if(e % 17 = 0, 'DENY', 'ALLOW')", ip=ip, dst="concat('203.0.113.', e % 7 + 1)")} END"""
    kind = "CASE WHEN e % 20 < 8 THEN 'auth' WHEN e % 20 < 15 THEN 'dns' ELSE 'firewall' END"
    beacon = [f"t + make_interval(0, 0, 0, 0, 0, 0, {jitter.format(k=k)})" for k in (0, 1)]
    tunnel = dns.format(iso=iso.format(at="t"), ip="'10.0.7.50'", name="concat(md5(cast(e AS STRING)), '.', md5(cast(e + 1 AS STRING)), '.exfil.badhost.net')")
    rows = [(0, "true", kind, usual)]
    rows += [(k + 1, "e % 30 = 0", "'firewall'", fw.format(iso=iso.format(at=beacon[k]), action="'ALLOW'", ip=f"'10.0.6.20{k}'", dst="'198.51.100.77'")) for k in (0, 1)]
    rows += [(3, "e % 5 = 3", "'dns'", tunnel)]
    structs = ", ".join(f"named_struct('k', {k}, 'ok', {ok}, 'kind', {kind_}, 'raw', {raw})" for k, ok, kind_, raw in rows)
    envelope = f"""CASE WHEN x.k = 0 AND e % 107 = 0 THEN concat('not json ', e)
        ELSE concat('{{"source_type":"', if(x.k = 0 AND e % 103 = 0, 'http', x.kind), '","host":"h', u % 4, '","received_at":"',
                    {iso.format(at="t + make_interval(0, 0, 0, 0, 0, 0, 1.5)")}, '","raw":"', if(x.k = 0 AND e % 101 = 0, concat('garbage ', e), x.raw), '"}}') END"""
    numbered = events.selectExpr("event_id AS e", "user_id AS u").selectExpr("e", "u", f"{t} AS t")
    return numbered.selectExpr("e", "u", "t", f"explode(array({structs})) AS x").filter("x.ok").selectExpr(f"e * {EACH} + x.k AS seq", f"{envelope} AS value")


def generated(spark: SparkSession, rows: int, users: int = 15) -> DataFrame:
    """A feed of any size, without a table."""
    return raw_feed(spark.range(rows).select(F.col("id").alias("event_id"), F.pmod(F.xxhash64("id"), F.lit(users)).alias("user_id")))
