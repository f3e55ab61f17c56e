"""Runs a registered query in Spark and its SQL in DuckDB, and compares the rows as multisets."""

import decimal
import math
import os

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 7) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def duck(sql: str, sf_dir: str = SF):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    r = con.sql(sql)
    order = sorted(r.columns)
    at = [r.columns.index(c) for c in order]
    return order, sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)


def compare(spark, name: str, sf_dir: str = SF) -> None:
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want_columns, want = duck(entry.oracle_sql()[name], sf_dir)
    assert columns == want_columns
    assert rows == want
