"""Offline training of the DNS baseline: median, and median absolute deviation as a standard deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.config import DnsModel
from palisade.functions.scalars import average_subdomain_entropy

#: Fixed value: what makes the deviation of normal data one standard deviation.
MAD_SCALE = 1.4826
LEAST_QUERIES = 100


def baseline(queries: DataFrame) -> DataFrame:
    """One row: queries, median, mad_std and mean of the entropies of a column dns_query.

    Exact medians of counted values: equal entropies combine before the shuffle, as names repeat."""
    counted = queries.filter("dns_query IS NOT NULL").groupBy("dns_query").agg(F.count("*").alias("n"))
    values = counted.select(average_subdomain_entropy(F.col("dns_query")).alias("entropy"), "n").groupBy("entropy").agg(F.sum("n").alias("n"))
    center = values.agg(F.sum("n").alias("queries"), F.percentile("entropy", 0.5, F.col("n")).alias("median"), (F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("mean"))
    off = values.crossJoin(F.broadcast(center))  # one row
    return off.groupBy("queries", "median", "mean").agg((F.percentile(F.abs(F.col("entropy") - F.col("median")), 0.5, F.col("n")) * MAD_SCALE).alias("mad_std"))


def trained(queries: DataFrame) -> DataFrame:
    """The baseline as one row (baseline_mean, baseline_std) of the plan, rounded as a model file has it. Too few queries are an error
    when it runs; of an empty corpus there is no row."""
    few = F.raise_error(F.format_string(f"the corpus has %d queries; {LEAST_QUERIES} are needed", "queries")).cast("double")
    enough = F.col("queries") >= LEAST_QUERIES
    return baseline(queries).select(F.when(enough, F.round("median", 4)).otherwise(few).alias("baseline_mean"), F.round("mad_std", 4).alias("baseline_std"))


def train(queries: DataFrame, z_threshold: float = 2.0, min_queries: int = 8, window_ms: int = 60_000) -> DnsModel:
    row = baseline(queries).first()
    if row is None or row["queries"] < LEAST_QUERIES:
        raise ValueError(f"the corpus has {row['queries'] if row else 0} queries; {LEAST_QUERIES} are needed")
    return DnsModel(round(row["median"], 4), round(row["mad_std"], 4), z_threshold, min_queries, window_ms)
