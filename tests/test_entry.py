"""The driver's contract, and queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as E

DIR = "/root/testdata/sf0.001"
SOME = ["A02_label_share", "A16_vote_distribution", "A15_conflict_features", "J10_ballot", "J18_asof_line", "B05_ratio", "H01_chi_square", "X03_alternation", "X17_cycles", "U04_line_sets", "p6_subtypes", "K05_stratified", "p6_found", "F34_vote_errors", "stream_sessions"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_norm, v)) + "]"
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


def test_names_agree():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) > 150


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = E.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    r = con.execute(E.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted("|".join(_norm(x[c]) for c in cols) for x in df.collect()) == sorted("|".join(_norm(x[i]) for i in at) for x in r.fetchall())
