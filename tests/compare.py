"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

import math
from pathlib import Path

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def canon(rows):
    return sorted((tuple(norm(x) for x in r) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


def check(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = canon([[r[names.index(c)] for c in order] for r in cur.fetchall()])
    got = canon([[r[c] for c in order] for r in df.collect()])
    assert got == want
