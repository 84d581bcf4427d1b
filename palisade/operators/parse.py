"""Envelopes and log lines to events; what can't be read becomes a dead letter with its reason."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.scalars import once
from palisade.schemas import ENVELOPE, EVENT, names

# The formats of log lines, as prefixes; lines may go on.
IP = r"[0-9a-fA-F.:]+"
AUTH = rf"^(\w{{3}}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}})\s+sshd\[\d+\]:\s+(Accepted|Failed)\s+\S+\s+for\s+(\S+)\s+from\s+({IP})\s+port\s+\d+"
DNS = rf"^(\S+)\s+queries:\s+client\s+({IP})#\d+:\s+query:\s+(\S+)\s+IN"
FIREWALL = rf"^(\S+)\s+(ALLOW|DENY)\s+(\S+)\s+src=({IP})\s+dst=({IP})\s+dport=(\d+)"
#: An instant needs seconds and a zone.
INSTANT = r"^[+-]?\d{4,}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}(:?\d{2}){0,2})$"

SOURCE_TYPES = ("auth", "dns", "firewall")


#: Parts of a line that a grammar gives are put behind this character, which is taken out of lines beforehand.
MARK = "\x01"


def parts(line: Column, pattern: str, n: int) -> Column:
    """The n groups of a line as an array, by one run of the pattern; null if it doesn't match."""
    marked = F.regexp_replace(F.translate(line, MARK, "\x02"), f"(?s){pattern}.*$", "".join(f"{MARK}${i}" for i in range(1, n + 1)))
    return F.when(F.substring(marked, 1, 1) == MARK, F.split(F.substring(marked, 2, 1 << 30), MARK))


def instant(text: Column) -> Column:
    """An ISO-8601 instant in whole milliseconds; null if it isn't one."""
    ts = F.when(text.rlike(INSTANT), F.upper(text).try_cast("timestamp"))
    return F.timestamp_millis(F.unix_millis(ts))


def syslog_time(text: Column, year: Column) -> Column:
    """'Sep  7 04:05:06' in a year, UTC."""
    spaced = F.regexp_replace(text, r"\s+", " ")
    return F.when(text.rlike("^[A-Z][a-z]{2}"), F.try_to_timestamp(F.concat(year.cast("string"), F.lit(" "), spaced), F.lit("yyyy MMM d HH:mm:ss")))


def _event(parts_: Column, fields: Callable[[Column], dict[str, Column]]) -> Column:
    """A struct with the columns of an event, made of a line's parts; null unless there are parts and a time (and a port, if it has one)."""
    kinds = dict(c.split() for c in EVENT.split(", "))

    def of(p: Column) -> Column:
        own = fields(p)
        return F.struct(*(own.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names(EVENT) if n not in ("source_type", "host", "raw")))

    def checked(e: Column) -> Column:
        bad = e["event_time"].isNull() | e["action"].isNotNull() & e["dest_port"].isNull()
        return F.when(~bad, e)

    return F.when(parts_.isNotNull(), once(once(parts_, of), checked))


def auth_event(line: Column, year: Column) -> Column:
    return once(parts(line, AUTH, 4), lambda x: _event(x, lambda p: {"event_time": syslog_time(p[0], year), "source_ip": p[3], "user": p[2], "auth_success": p[1] == "Accepted"}))


def dns_event(line: Column) -> Column:
    return once(parts(line, DNS, 3), lambda x: _event(x, lambda p: {"event_time": instant(p[0]), "source_ip": p[1], "dns_query": p[2]}))


def firewall_event(line: Column) -> Column:
    fields = lambda p: {"event_time": instant(p[0]), "source_ip": p[3], "dest_ip": p[4], "dest_port": p[5].try_cast("int"), "action": p[1]}
    return once(parts(line, FIREWALL, 6), lambda x: _event(x, fields))


def parsed_event(source_type: Column, line: Column, year: Column | int | None = None) -> Column:
    """The event of a line by its source type; null if the line isn't one of it. Without a year, auth lines get the current one (UTC)."""
    y = F.lit(year) if isinstance(year, int) else F.year(F.current_timestamp()) if year is None else year
    return F.when(source_type == "auth", auth_event(line, y)).when(source_type == "dns", dns_event(line)).when(source_type == "firewall", firewall_event(line))


def computed_once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """``df`` and a column. A filter on the column stays above it, so that the column isn't computed for the filter and again for
    its result, as it would be if the optimizer moved the filter down."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def decoded(raw: DataFrame, year: int | None = None, strict: bool = True, value: str = "value") -> DataFrame:
    """``raw`` and the columns ``envelope``, ``kind`` (its source type), ``event`` and ``error``; one of error and event is null.

    strict: an envelope with a key that isn't one of its own is an error, too."""
    v = F.col(value)
    env = F.from_json(v, f"{ENVELOPE}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ok = F.json_object_keys(v)
    fits = once(ok, lambda keys: keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, names(ENVELOPE))))) == 0)) if strict else ok.isNotNull()
    read = F.when(v.isNotNull() & F.coalesce(fits, F.lit(False)), once(env, lambda e: F.when(e["_bad"].isNull(), e)))
    out = computed_once(raw, read, "envelope").withColumn("kind", F.col("envelope.source_type"))
    out = computed_once(out, parsed_event(F.col("kind"), F.col("envelope.raw"), year), "event")
    error = (
        F.when(F.col("event").isNotNull(), None)
        .when(F.col("envelope").isNull(), F.concat(F.lit("json_decode_error: "), F.coalesce(v, F.lit("null"))))
        .when(F.coalesce(F.col("kind").isin(*SOURCE_TYPES), F.lit(False)), F.concat(F.lit("parse_error("), "kind", F.lit("): "), v))
        .otherwise(F.concat(F.lit("unknown_source_type("), F.coalesce("kind", F.lit("null")), F.lit("): "), v))
    )
    return out.withColumn("error", error)


def event_columns() -> dict[str, Column]:
    """The columns of an event (EVENT) in what has been decoded."""
    own = {"source_type": F.col("kind"), "host": F.col("envelope.host"), "raw": F.col("envelope.raw")}
    return {n: own.get(n, F.col(f"event.{n}")) for n in names(EVENT)}


def events(decoded_: DataFrame) -> DataFrame:
    """The events (EVENT)."""
    return decoded_.filter("event IS NOT NULL").select(*(c.alias(n) for n, c in event_columns().items()))


def dead_letters(decoded_: DataFrame) -> DataFrame:
    """reason and message of what couldn't be read."""
    return decoded_.filter("event IS NULL").select(F.regexp_extract("error", r"^(\w+)", 1).alias("reason"), F.col("error").alias("message"))


def lines(source_type: str, text: DataFrame, year: int | None = None) -> DataFrame:
    """Events of plain log lines (column value), without envelopes; others are left out."""
    rows = text.select(F.trim(F.col("value")).alias("raw"))
    got = computed_once(rows, parsed_event(F.lit(source_type), F.col("raw"), year), "event").filter("event IS NOT NULL")
    own = {"source_type": F.lit(source_type), "host": F.lit(None).cast("string"), "raw": F.col("raw")}
    return got.select(*(own.get(n, F.col(f"event.{n}")).alias(n) for n in names(EVENT)))


def all_lines(given: dict[str, DataFrame], year: int | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, (lines(k, v, year) for k, v in given.items()))


def quality_counts(events_: DataFrame) -> DataFrame:
    """How many events have a port that no port is."""
    return events_.groupBy("source_type").agg(F.count("*").alias("events"), F.count_if(~F.col("dest_port").between(0, 65535)).alias("bad_ports"))
