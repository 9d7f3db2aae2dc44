"""Holding a query's rows against DuckDB's."""

import glob
import os

import duckdb


def rows_of(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).lower().startswith(("float", "int", "uint", "bool", "decimal")):
            frame[c] = frame[c].astype(float).round(6)
        else:
            frame[c] = frame[c].astype(str)
    return frame.sort_values(list(frame.columns), ignore_index=True)


def by_sql(sf_dir, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con.execute(sql).df()


def assert_same(got, want):
    got, want = rows_of(got), rows_of(want)
    assert list(got.columns) == list(want.columns)
    assert got.shape == want.shape
    differ = (got != want) & ~(got.isna() & want.isna())
    assert not differ.any().any(), (got[differ.any(axis=1)].head(3), want[differ.any(axis=1)].head(3))
