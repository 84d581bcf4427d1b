import json
from datetime import datetime

import pytest

from palisade.operators import parse
from palisade.sources import files

AUTH = "Sep  7 04:05:06 sshd[12]: Failed password for bob from 10.0.0.1 port 22 ssh2"
DNS = "2024-09-07T04:05:06.250+02:00 queries: client 10.0.0.2#53: query: mail.example.com IN A + (x) more"
FIREWALL = "2024-09-07T04:05:06Z ALLOW TCP src=10.0.0.3 dst=1.2.3.4 dport=443 extra"


def envelope(kind, raw, **more):
    return json.dumps({"source_type": kind, "host": "h", "received_at": "2024-09-07T04:05:07Z", "raw": raw} | more)


def run(spark, *values, **options):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    d = parse.decoded(df, year=2024, **options)
    return parse.events(d).collect(), [r.message for r in parse.dead_letters(d).collect()]


def test_each_grammar(spark):
    got, dead = run(spark, envelope("auth", AUTH), envelope("dns", DNS), envelope("firewall", FIREWALL))
    assert dead == []
    a, d, f = got
    assert (a.event_time, a.source_ip, a.user, a.auth_success, a.dns_query) == (datetime(2024, 9, 7, 4, 5, 6), "10.0.0.1", "bob", False, None)
    assert (d.event_time, d.source_ip, d.dns_query, d.auth_success) == (datetime(2024, 9, 7, 2, 5, 6, 250_000), "10.0.0.2", "mail.example.com", None)
    assert (f.source_ip, f.dest_ip, f.dest_port, f.action, f.raw) == ("10.0.0.3", "1.2.3.4", 443, "ALLOW", FIREWALL)


@pytest.mark.parametrize(
    ("value", "reason"),
    [
        ("not json", "json_decode_error"),
        ("null", "json_decode_error"),
        ("[]", "json_decode_error"),
        ("", "json_decode_error"),
        (None, "json_decode_error"),
        (envelope("http", AUTH), "unknown_source_type(http)"),
        (envelope(None, AUTH), "unknown_source_type(null)"),
        (envelope("auth", None), "parse_error(auth)"),
        (envelope("auth", AUTH.replace("bob", "invalid user bob")), "parse_error(auth)"),
        (envelope("auth", AUTH.replace("Sep  7", "Feb 30")), "parse_error(auth)"),
        (envelope("auth", AUTH.replace("Sep", "sep")), "parse_error(auth)"),
        (envelope("firewall", FIREWALL.replace("443", "99999999999")), "parse_error(firewall)"),
        (envelope("firewall", FIREWALL.replace("06Z", "06")), "parse_error(firewall)"),
        (envelope("dns", DNS.replace("T04:05:06.250+02:00", "")), "parse_error(dns)"),
        (envelope("dns", FIREWALL), "parse_error(dns)"),
        (envelope("auth", AUTH, more=1), "json_decode_error"),
    ],
)
def test_dead_letters(spark, value, reason):
    got, dead = run(spark, value)
    assert got == []
    assert dead == [f"{reason}: {value if value is not None else 'null'}"]


def test_lenient_envelopes(spark):
    got, dead = run(spark, envelope("auth", AUTH, more=1), strict=False)
    assert len(got) == 1
    assert dead == []


def test_empty(spark):
    assert run(spark) == ([], [])


def test_log_files(spark, tmp_path):
    (tmp_path / "auth.log").write_text(f"{AUTH}\n\n  {AUTH}  \nnonsense\n")
    (tmp_path / "dns.log").write_text(f"{DNS}\nx\n")
    got = files.log_files(spark, auth=str(tmp_path / "auth.log"), dns=str(tmp_path / "dns.log"), year=2024)
    assert sorted(r.source_type for r in got.collect()) == ["auth", "auth", "dns"]
    queries, bad = files.dns_corpus(spark, [str(tmp_path / "dns.log")])
    assert [r.dns_query for r in queries.collect()] == ["mail.example.com"]
    assert bad.first().unparsed == 1
    with pytest.raises(ValueError, match="no log file"):
        files.log_files(spark)


def test_alert_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("beaconing\ta\tb\t0.5\tx\textra\n\nshort\ta\nt\ta\t\tn/a\ty\n")
    got = [tuple(r) for r in files.alert_tsv(spark, str(tmp_path / "a.tsv")).collect()]
    assert got == [("beaconing", "a", "b", 0.5, "x"), ("t", "a", "", 0.0, "y")]
