"""Every registered query against its SQL, over the smallest tables."""

import pytest

from oracle import connect, differences
from postlens.plans import registered

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered()


@pytest.fixture(scope="module")
def tables():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert not differences(got, tables.sql(ORACLES[name]).df())


def test_queries_cut_no_posts(spark):
    from postlens.plans import bind

    assert bind.posts(spark, SMALL).count() == bind.table(spark, SMALL, "events").count()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, SMALL)
    assert len(rows.collect()) > 0 and rows.columns
