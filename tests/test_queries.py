"""Registered queries against their SQL, on the smallest data; and the plans of some."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from vellum.plans import queries as core
from vellum.plans.shared import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(core.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    p = plan(core.QUERIES["fil1_searchable"](spark, DATA))
    assert "PushedFilters: [In(chunk_type" in p and "vector" not in p


def test_scans_read_few_columns(spark):
    p = plan(core.QUERIES["agg3_doc_state"](spark, DATA))
    assert "ReadSchema: struct<source_path:string,source_sha256:string>" in p
    assert "text" not in p.split("ReadSchema")[1]


def test_no_cartesian(spark):
    for name in ("ret1_knn", "jon1_sync_plan", "src8_merge", "p3_found", "evd1_paragraph_dedup"):
        p = plan(core.QUERIES[name](spark, DATA))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_extra_columns_do_not_clash(spark):
    from pyspark.sql import functions as F

    from vellum.plans.sync import document_state

    t = table(spark, DATA, "research_chunk")
    assert document_state(t.withColumn("n", F.lit(1)).withColumn("h", F.lit(2))).count() == document_state(t).count()
