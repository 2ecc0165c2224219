"""Every query with SQL gives DuckDB's rows, at the smallest scale."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from quern import registry

DATA = Path("/root/testdata/sf0.001")


def cells(frame):
    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>"):
            return "null"
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iufb" else str(x)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got, want = registry.queries()[name](spark, str(DATA)).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, str(DATA)).count() > 0
