"""The queries of the subpackage on the smallest tables, against SQL where there is any."""

import glob
import os

import pytest

from tidewell.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name):
    got = Q.QUERIES[name](spark, DATA).toPandas()
    if name in Q.ORACLE_SQL:
        import duckdb

        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        want = con.execute(Q.ORACLE_SQL[name]).df()
        assert sorted(map(tuple, got[sorted(got.columns)].values.tolist())) == sorted(map(tuple, want[sorted(want.columns)].values.tolist()))
    else:
        assert len(got.columns) and (len(got) or name.startswith("p6"))
