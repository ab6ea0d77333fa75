import glob
import os

import duckdb
import pytest

from vellum.llm import queries as llm

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {
    "p1_found": [("chunk_a", "string"), ("chunk_b", "string")],
    "p2_found": [("page_id", "bigint"), ("line_no", "int"), ("fault", "string"), ("word", "string")],
    "p4_found": [("item_kind", "string"), ("item_id", "string"), ("boundary", "string")],
    "p5_found": [("item_kind", "string"), ("id_a", "string"), ("id_b", "string")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_runs(spark, name):
    df = llm.QUERIES[name](spark, DATA)
    got = df.collect()
    assert df.dtypes == COLUMNS.get(name, df.dtypes)
    if name.endswith("_found"):
        assert got and len(set(got)) == len(got)


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM read_parquet('{p}')")
    df = llm.QUERIES[name](spark, DATA)
    r = con.execute(llm.SQL[name])
    at = [[c[0] for c in r.description].index(c) for c in df.columns]
    assert sorted((tuple(x) for x in df.collect()), key=repr) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
