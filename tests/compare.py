"""Compare Spark rows with DuckDB rows, columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def spark_rows(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[str]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())
