"""Comparison of a query with its DuckDB counterpart."""

import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def expected(sql, sf):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    r = c.sql(sql)
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return sorted(r.columns), sorted((tuple(normal(row[i]) for i in order) for row in r.fetchall()), key=repr)


def same(df, sql, sf):
    columns, rows = expected(sql, sf)
    assert sorted(df.columns) == columns
    got = sorted((tuple(normal(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    assert got == rows
