"""Every query of the diffusion engine against its SQL."""

import duckdb
import pytest

from voxelmill.plans import fitting, queries, subjects, twins

QUERIES, SQL = queries.QUERIES | fitting.QUERIES | subjects.QUERIES | twins.QUERIES, queries.SQL | fitting.SQL | subjects.SQL | twins.SQL
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "lineitem", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(map(str, d[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
