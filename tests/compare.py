"""Runs a registered query in Spark and its SQL in DuckDB and compares columns and rows."""

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(row[i] for i in order) for row in rows), key=lambda row: tuple((v is not None, str(v)) for v in row)
    )


def difference(frame, connection, sql):
    """None when both give the same, otherwise the first thing that differs."""
    columns, got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    cursor = connection.execute(sql)
    names, want = rows_of([item[0] for item in cursor.description], cursor.fetchall())
    if columns != names:
        return f"columns {columns} instead of {names}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"{mine} instead of {theirs}"
    return None
