"""Every SQL-checked catalogue query against its DuckDB oracle on sf0.001."""
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels")


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")
def test_all_oracles(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    bad = []
    for k, sql in orc.items():
        df = qs[k](spark, SF)
        s = _canon(df.columns, [tuple(r) for r in df.collect()])
        cur = con.execute(sql)
        d = _canon([c[0] for c in cur.description], cur.fetchall())
        if s != d:
            bad.append(k)
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and {"domain", "split", "f1"} <= set(df.columns)
