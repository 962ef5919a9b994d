import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(names, data):
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple((k, clean(v)) for k, v in sorted(zip(names, r))) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert {r.split for r in entry.entry(spark).collect()} == {"train", "validation"}
