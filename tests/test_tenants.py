"""Queries of tenants that build on all pairs: they run, and give what their SQL gives."""

from collections import Counter
from pathlib import Path

import duckdb

from revisit_spark.plans import tenant_queries

TABLES = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(TABLES).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = Counter(tuple(map(str, r)) for r in tenant_queries.QUERIES[name](spark, TABLES).collect())
    expect = Counter(tuple(map(str, r)) for r in con.execute(tenant_queries.SQL[name]).fetchall())
    return expect and got == expect


def test_repeat_equipment_equals_its_sql(spark):
    assert same_as_sql(spark, "repeat_equipment")


def test_review_export_equals_its_sql(spark):
    assert same_as_sql(spark, "review_export")
