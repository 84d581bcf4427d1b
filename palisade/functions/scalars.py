"""Column functions: entropy of labels, scores, time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""

    def of(s: Column) -> Column:
        chars = F.filter(F.split(s, ""), lambda c: c != "")
        n = F.size(chars)
        share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
        bits = F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))
        return F.when(n > 0, F.greatest(bits, F.lit(0.0))).otherwise(F.lit(0.0))

    return once(text, of)


def average_subdomain_entropy(name: Column) -> Column:
    """Mean entropy of a name's labels but the last two; of one with two or fewer, its first label's. Trailing dots don't count."""

    def of(labels: Column) -> Column:
        n = F.size(labels)
        own = F.when(n <= 2, F.slice(labels, 1, 1)).otherwise(F.slice(labels, 1, F.greatest(n - 2, F.lit(1))))
        return F.aggregate(F.transform(own, shannon_entropy), F.lit(0.0), lambda a, b: a + b) / F.greatest(F.size(own), F.lit(1))

    return once(F.split(F.regexp_replace(name, r"\.+$", ""), r"\."), of)


def once(column: Column, f) -> Column:  # noqa: ANN001
    """f(column), with the column computed once."""
    return F.element_at(F.transform(F.array(column), f), 1)


def z_score(mean: Column, baseline_mean: Column | float, baseline_std: Column | float) -> Column:
    """0 without a spread."""
    std = F.lit(baseline_std)
    return F.when(std > 0, (mean - F.lit(baseline_mean)) / std).otherwise(0.0)


def capped(score: Column) -> Column:
    """A score in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def bucket(ts: Column, width_ms: int) -> Column:
    """The start of the epoch-aligned bucket that a time is in, in milliseconds."""
    ms = millis(ts)
    return ms - F.pmod(ms, F.lit(width_ms))


def seconds_between(a: Column, b: Column) -> Column:
    """Second boundaries between two times, not the truncated difference."""
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def shortened(text: Column, most: int) -> Column:
    """Tabs as spaces; longer texts end with three dots."""
    t = F.translate(text, "\t", " ")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)
