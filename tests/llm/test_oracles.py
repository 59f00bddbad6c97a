"""The opN queries against their SQL twins, on the driver's tables."""

from pathlib import Path

import pytest

from pagequarry.llm import oracles, queries
from tests.oracle_check import duck_rows, normal

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    df = queries.queries()[name](spark, DATA)
    rows, columns = duck_rows(oracles.oracle_sql()[name], DATA)
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.collect(), df.columns) == normal(rows, columns)
