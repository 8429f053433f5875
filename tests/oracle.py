"""Comparison of a query with its SQL over the same folder of tables."""

import collections
import os

import duckdb


def database(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
            con.execute(f"create view {f[:-8]} as select * from '{path}'")
    return con


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else str(x) if isinstance(x, (list, dict)) else x for x in row)


def differences(df, con, sql):
    cols = sorted(df.columns)
    got = collections.Counter(plain(r) for r in df.select(*(df[f"`{c}`"] for c in cols)).collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = collections.Counter(plain([r[i] for i in at]) for r in result.fetchall())
    return list((got - want).items())[:3], list((want - got).items())[:3]
