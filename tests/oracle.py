"""Compare a query with its SQL on the same tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, int):
        return v
    return str(v)


def _key(row):
    return tuple((x is not None, str(x)) for x in row)


def compare(df, con, sql):
    """Empty when equal, else a short report."""
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns differ: {cols} / {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in cur.fetchall()), key=_key)
    if len(got) != len(want):
        return f"row counts differ: {len(got)} / {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if not bad:
        types = {c: set() for c in cols}
        for rows in (got, want):
            for r in rows[:1000]:
                for c, v in zip(cols, r):
                    if v is not None:
                        types[c].add(type(v).__name__)
        mixed = {c: t for c, t in types.items() if len(t) > 1}
        return f"types differ: {mixed}" if mixed else ""
    g, w = bad[0]
    diff = {c: (a, b) for c, a, b in zip(cols, g, w) if a != b}
    return f"{len(bad)} rows differ, first: {diff} in {dict(zip(cols, g))}"
