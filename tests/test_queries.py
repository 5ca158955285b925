"""Every query with SQL is held against DuckDB on the smallest tables."""

import pytest
from oracle import connect, rows

from lodestream.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = rows(registry.queries()[name](spark, SF).toArrow())
    want = rows(con.sql(registry.oracle_sql()[name]).to_arrow_table())
    assert got == want


def test_every_query_has_rows(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, SF).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() > 0
