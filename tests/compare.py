"""Run a query and its SQL over the same tables."""

import datetime
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def views(folder: str = DATA):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def same(spark, query, sql, folder: str = DATA):
    df = query(spark, folder)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    got = views(folder).execute(sql)
    theirs = [d[0] for d in got.description]
    assert sorted(theirs) == names
    rows = sorted((tuple(plain(dict(zip(theirs, r))[n]) for n in names) for r in got.fetchall()), key=repr)
    assert ours == rows
