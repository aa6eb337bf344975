"""Holds a query's rows against those that its SQL gives in DuckDB."""

import math
import os

import duckdb

DATA = "/root/testdata"


def connect(root: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(root):
        path = f"{root}/{file}"
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "null" if value is None else str(value)


def assert_same(df, db, sql: str) -> None:
    wanted = db.execute(sql)
    names = [d[0] for d in wanted.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert got == sorted(tuple(map(plain, r)) for r in wanted.fetchall())
