"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from voltide.plans import registry

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for n in TABLES:
        c.execute(f"create view {n} as select * from read_parquet('{sf}/{n}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, pd.Timestamp):
        return str(v).removesuffix(" 00:00:00")
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 8))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got) > 0
        return
    want = con.execute(registry.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
