"""Runs a query and its SQL side by side and compares the rows."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def compare(df, con, sql):
    """What differs: a text, empty if nothing does."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    names = ", ".join(f'"{c}"' for c in cols)
    theirs = Counter(tuple(plain(x) for x in r) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}, only theirs {list((theirs - ours).items())[:3]}"
