"""Compare a query's rows with those of its SQL."""

from __future__ import annotations

import glob
import math
import os


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(_plain(r[k]) for k in order) for r in records)


def same(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = rows([c[0] for c in cursor.description], cursor.fetchall())
    return ours, theirs
