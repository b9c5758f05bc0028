"""Every registered core query against its SQL in DuckDB, and the shape of those without."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from terrane.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, list | np.ndarray):
        return tuple(plain(x) for x in value)
    if hasattr(value, "item"):
        value = value.item()
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    return round(float(value), 5) + 0.0 if isinstance(value, float) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows(got)] == [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows(want)]
