import math
import os

import duckdb
import pytest

import __spark_entry__
from foliospark.plans import geometry_queries, model_queries, page_queries, source_queries, text_queries

SF = "/root/testdata/sf0.001"
OWN = {n: s for m in (page_queries, text_queries, model_queries, source_queries, geometry_queries) for n, s in m.ORACLE.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = __spark_entry__.queries()[name](spark, SF)
    rel = con.sql(OWN[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    want = sorted(repr([norm(r[rel.columns.index(c)]) for c in cols]) for r in rel.fetchall())
    assert got == want
