"""Runs a query and its SQL over one folder of tables and compares rows."""

import glob
import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def same(spark, query, sql):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in names)).collect())
    cursor = db.execute(sql)
    have = [x[0] for x in cursor.description]
    assert sorted(have) == names
    order = [have.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
