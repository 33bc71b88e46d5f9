"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from noteloom.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else (f"{v:.6g}" if isinstance(v, float) else str(list(v)) if hasattr(v, "tolist") and hasattr(v, "__len__") else str(v)) for v in df[c]]
    return sorted(map(tuple, df.fillna("∅").values.tolist())), list(df.columns)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, db, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(db.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
