"""Compare Spark rows with DuckDB rows: order-free, floats to nine digits."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def norm(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(float(f"{float(v):.9g}"))
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v).replace("+00:00", "")
    return str(v)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(norm(x[i]) for i in order) for x in r.fetchall())
