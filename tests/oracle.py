"""Compare a frame with DuckDB SQL over the same tables, order aside."""

import decimal
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def shown(v):
    if v is None:
        return "NULL"
    if isinstance(v, float | decimal.Decimal) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def rows_of_sql(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def assert_same(df, sql, sf):
    names, want = rows_of_sql(sql, sf)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    left = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    right = sorted(tuple(shown(r[names.index(c)]) for c in order) for r in want)
    assert left == right
