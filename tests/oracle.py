"""Runs the SQL side of a check in DuckDB and brings both sides to one form."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def sorted_rows(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(row[i]) for i in places) for row in rows), key=repr)


def from_duckdb(con, sql):
    result = con.execute(sql)
    columns = [column[0] for column in result.description]
    return sorted_rows(columns, result.fetchall())


def from_spark(df):
    return sorted_rows(df.columns, [tuple(row) for row in df.collect()])
