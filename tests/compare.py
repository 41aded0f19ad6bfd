"""Run a query on Spark and its SQL on DuckDB over the same files."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f'CREATE VIEW "{name}" AS SELECT * FROM read_parquet(\'{path}\')')
    return con


def _plain(value):
    # exact: a value may only differ in how the driver spells its type
    if isinstance(value, decimal.Decimal):
        raise AssertionError(f"decimal {value} in a result")
    if isinstance(value, dt.datetime) and value.tzinfo:
        raise AssertionError(f"zoned timestamp {value}")
    return value


_KINDS = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def spark_rows(df):
    names = sorted(df.columns)
    types = {f.name: _KINDS[f.dataType.simpleString()] for f in df.schema}
    rows = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    return [(n, types[n]) for n in names], rows


def duck_rows(con, sql):
    rel = con.sql(sql)
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    return [(n, types[n]) for n in names], [
        tuple(_plain(r[i]) for i in at) for r in rel.fetchall()
    ]


def sort_key(row):
    return tuple((v is not None, str(v)) for v in row)


def differences(df, con, sql) -> list[str]:
    sn, sr = spark_rows(df)
    dn, dr = duck_rows(con, sql)
    out = []
    if sn != dn:
        out.append(f"columns {set(sn) ^ set(dn)}")
    if len(sr) != len(dr):
        out.append(f"rows {len(sr)} against {len(dr)}")
    sr, dr = sorted(sr, key=sort_key), sorted(dr, key=sort_key)
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0][0]} against {bad[0][1]}")
    return out
