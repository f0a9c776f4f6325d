"""Every registered query with SQL equals that SQL on the smallest tables."""

import importlib
import math
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")


#: The default extractor finds literal objects alone.
NEVER_FILLED = {"extracted_claims": ("object_entity", "object_entity_id")}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = db.sql(entry.oracle_sql()[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert sorted(tuple(plain(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())


@pytest.mark.parametrize("name", sorted({*entry.queries()} - {*entry.oracle_sql()}))
def test_query_gives_whole_distinct_rows(spark, name):
    """What has no SQL is compared with brute force or fixed cases in tests of its operator; here its rows on real tables are
    there, are told apart, and have none of the columns empty throughout."""
    rows = [tuple(plain(x) for x in r) for r in entry.queries()[name](spark, DATA).collect()]
    assert rows and len(set(rows)) == len(rows)
    columns = entry.queries()[name](spark, DATA).columns if name in NEVER_FILLED else [""] * len(rows[0])
    assert all(any(c) or n in NEVER_FILLED.get(name, ()) for n, c in zip(columns, zip(*rows, strict=True), strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
