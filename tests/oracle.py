"""Compares a query with its SQL in DuckDB on one data folder."""

import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf=SF):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {name} as select * from read_parquet('{src}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def norm(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql, sf=SF):
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    rel = connect(sf).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    want = rel.fetchall()
    a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (len(bad), bad[:3])
    return len(a)
