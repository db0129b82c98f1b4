import glob
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def test_names_agree():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 60


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", ["tokenize", "bm25_topk", "history_budget", "request_validate", "span_intersect", "canonical_offsets", "p3_found"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(map(str, map(tuple, df.select(columns).collect())))
    r = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(str, r))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
