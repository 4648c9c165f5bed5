"""Compare a query with its oracle SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "None"
    if hasattr(x, "item"):
        x = x.item()
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted(tuple(plain(r[c]) for c in order) for r in rows)


def oracle_rows(sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    return names, rows_of(names, [dict(zip(names, r)) for r in got.fetchall()])


def assert_equal(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names, want = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [r.asDict() for r in df.collect()]) == want
