"""What lets all workers work: Python finds this package, small tables are dealt out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def findable(spark: SparkSession) -> None:
    """Workers that start from now on look where the driver has found the package, too. On machines without that folder it
    does nothing; they get the package with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


#: Bytes of a table up to which it is worth dealing out anew.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt out over all cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
