import pytest

from palisade.plans import queries as plans
from tests.compare import TABLES, same

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, name):
    same(spark, plans.queries()[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    got = e.entry(spark)
    assert got.count() > 0
    assert "alert_type" in got.columns
    assert set(plans.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["alert_union", "dns_alerts_trained", "q1_noisy_sources", "q6_ingest_lag", "stream_alerts", "stream_events"])
def test_empty_feed(spark, tmp_path_factory, name):
    path = f"{tmp_path_factory.getbasetemp()}/empty"
    spark.read.parquet(f"{TABLES}/events.parquet").limit(0).coalesce(1).write.mode("ignore").parquet(f"{path}/events.parquet")
    assert plans.queries()[name](spark, path).count() == 0


def test_changed_source_is_built_anew(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    rows = spark.read.parquet(f"{TABLES}/events.parquet")
    rows.limit(10).write.parquet(path)
    few = plans.events(spark, str(tmp_path)).count()
    assert plans.events(spark, str(tmp_path)).inputFiles() == plans.events(spark, str(tmp_path)).inputFiles()
    rows.limit(100).write.mode("append").parquet(path)
    assert plans.events(spark, str(tmp_path)).count() > few
