"""Compares queries with their SQL on the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    return (0, "") if x is None or (isinstance(x, float) and math.isnan(x)) else (1, round(float(x), 5)) if isinstance(x, (int, float)) and not isinstance(x, bool) else (2, str(x))


def same(spark, con, fn, sql, sf_dir):
    """None, or what differs."""
    df = fn(spark, sf_dir)
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} for {sorted(names)}"
    order = sorted(names)
    a = sorted([tuple(plain(r[c]) for c in order) for r in got])
    b = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in want])
    if a != b:
        bad = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{len(a)} rows for {len(b)}: {bad}"
    return None
