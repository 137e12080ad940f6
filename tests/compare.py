"""Rows of a query in Spark against its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_number(value):
    if isinstance(value, float):
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(same_number, value))
    return value


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(same_number, r)) for r in df.select(*columns).collect()), key=repr)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(same_number(r[i]) for i in order) for r in got.fetchall()), key=repr)
