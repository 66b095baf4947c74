"""Compare a query with its DuckDB SQL, as sorted rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "asDict"):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(plain(x) for x in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(names).collect()]
    found = views(sf_dir).sql(sql)
    assert sorted(found.columns) == names
    order = [found.columns.index(n) for n in names]
    want = [tuple(plain(r[k]) for k in order) for r in found.fetchall()]
    assert len(got) == len(want)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g == w
    return len(got)
