"""Every registered query of the catalogue against its SQL twin, on the driver's small tables."""

from pathlib import Path

import pytest

from pagequarry.plans import catalogue
from tests.oracle_check import duck_rows, normal

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    got = normal(df.collect(), df.columns)
    rows, columns = duck_rows(catalogue.oracle_sql()[name], DATA)
    assert sorted(df.columns) == sorted(columns)
    assert got == normal(rows, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() == 50


@pytest.mark.parametrize("name", ["stream_dedup_queue", "stream_live_stats", "stream_state_machine", "stream_tier_learning"])
def test_streams_read_tables_that_are_folders(spark, tmp_path, name):
    for t in ("pages", "events"):
        spark.read.parquet(f"{DATA}/{t}.parquet").repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    df = catalogue.queries()[name](spark, str(tmp_path))
    got = normal(df.collect(), df.columns)
    rows, columns = duck_rows(catalogue.oracle_sql()[name], str(tmp_path))
    assert rows and got == normal(rows, columns)
