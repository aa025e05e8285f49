"""Every registered query with SQL gives DuckDB's rows on a small scale."""

import os

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
from spanloom.plans import catalog  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda v: "null" if pd.api.types.is_scalar(v) and pd.isna(v) else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)
    num = lambda v: float(v) if type(v).__name__ in ("int64", "int32", "int", "float64", "float32") else v
    return sorted(tuple(text(num(v)) for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toArrow().to_pandas()
    if name not in catalog.ORACLE_SQL:
        assert list(got.columns)
        return
    want = con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
