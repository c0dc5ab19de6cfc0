"""Every query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from newslake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def shown(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    clean = lambda v: None if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v else round(float(v), 6) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiu" or isinstance(v, int) and not isinstance(v, bool) else str(v)
    return [columns, *sorted((tuple(map(clean, r)) for r in frame[columns].itertuples(index=False)), key=str)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert shown(got) == shown(duck.execute(ORACLES[name]).df())
    else:
        assert len(got.columns)
