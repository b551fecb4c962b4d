"""Runs a query's SQL on the other engine and compares rows."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def compare(df, sql: str, sf: str):
    names, other = rows_of_sql(sql, sf)
    order = sorted(names)
    assert sorted(df.columns) == order
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in other)
