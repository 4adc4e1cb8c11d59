"""The registered queries: names, oracles, a few runs against the checking SQL."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_registry():
    q, s = E.queries(), E.oracle_sql()
    assert len(q) > 80 and set(s) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["p6_found", "scr_composite", "sig_funding_velocity", "grf_funded_by_agency", "snp_deltas"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got, want = E.queries()[name](spark, SF).toPandas(), con.execute(E.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    norm = lambda d: sorted(tuple("" if v is None or v != v else str(v)[:10] if hasattr(v, "year") else str(round(float(v), 6)) if isinstance(v, (int, float)) else str(v) for v in r) for r in d[cols].itertuples(index=False))
    assert norm(got) == norm(want)


def test_entry(spark):
    if os.path.isdir(SF):
        assert E.entry(spark).count() > 0
