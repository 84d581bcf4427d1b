"""Files that hold logs, alerts and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import parse


def log_files(spark: SparkSession, auth: str | None = None, dns: str | None = None, firewall: str | None = None, year: int | None = None) -> DataFrame:
    """Events of plain log files, of those kinds that are given; lines that aren't of their kind are left out."""
    given = {k: spark.read.text(v) for k, v in {"auth": auth, "dns": dns, "firewall": firewall}.items() if v}
    if not given:
        raise ValueError("no log file is given")
    return parse.all_lines(given, year)


def dns_corpus(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """dns_query of the lines of DNS logs, and one row with the number of lines that aren't such."""
    text = spark.read.text(paths).filter(F.trim("value") != "")
    line = F.trim(F.col("value"))
    return text.filter(line.rlike(parse.DNS)).select(parse.parts(line, parse.DNS, 3)[2].alias("dns_query")), text.agg(F.count_if(~line.rlike(parse.DNS)).alias("unparsed"))


def alert_fields(text: DataFrame) -> DataFrame:
    """alert_type, source_ip, dest_ip, score, details of tab-separated lines (column value); those with fewer fields are left out, a score that is no number is 0."""
    f = F.split("value", "\t")
    own = text.filter((F.col("value") != "") & (F.size(f) >= 5))
    return own.select(*(F.get(f, i).alias(n) for i, n in enumerate(("alert_type", "source_ip", "dest_ip"))), F.coalesce(F.get(f, 3).try_cast("double"), F.lit(0.0)).alias("score"), F.get(f, 4).alias("details"), *[c for c in text.columns if c != "value"])


def alert_tsv(spark: SparkSession, path: str) -> DataFrame:
    return alert_fields(spark.read.text(path))


def feed(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of envelopes, one a line, from files that appear in a folder; a file counts once it is there as a whole."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(path).filter("value <> ''")


def kafka(spark: SparkSession, servers: str, topic: str, most: int = 100_000) -> DataFrame:
    """A stream of envelopes from a Kafka topic, from the earliest offset on if there is no checkpoint; needs Spark's Kafka connector."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(most)}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))
