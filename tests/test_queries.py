"""Registered queries against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import pytest

from vacantia.plans import registry

SF = "/root/testdata/sf0.001"
CHECKED = sorted(registry.oracle_sql())


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return f"{v} 00:00:00"
    return v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want


def equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    return got


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_every_job_has_a_prompt(spark, duck):
    got = equals_sql(spark, duck, "prompts_whole")
    assert len(got) == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert not any(p.endswith("...") for _, p in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_dual_comparison_covers_all_gold(spark, duck):
    equals_sql(spark, duck, "dual_pipeline_whole")
    by = {(r.skill_type, r.view): r for r in registry.queries()["dual_pipeline_whole"](spark, SF).collect()}
    want = duck.execute("SELECT count(DISTINCT p_name) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 10 = 0 AND l_linenumber <= 4").fetchone()[0]
    assert by["all", "text"].tp + by["all", "text"].fn == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
