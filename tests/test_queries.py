"""Every named query at the smallest scale against its SQL."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from check_queries import TABLES, compare  # noqa: E402
from vanemesh.plans import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    text, _, fine = compare(spark, con, name, SF)
    spark.catalog.clearCache()
    assert fine, text


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
