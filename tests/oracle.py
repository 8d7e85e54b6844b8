"""Compares a query with its SQL equivalent on DuckDB."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(row[columns.index(c)]) for c in order) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r.asDict(True)[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want
