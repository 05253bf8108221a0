"""Run catalog queries on Spark and their SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((x is not None, str(type(x)), x if not isinstance(x, bool) else int(x)) for x in row)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(rows, key=_key)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else the first difference."""
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else []
        lack = [r for r in want if r not in set(got)][:2] if len(got) < 20000 else []
        return f"rows {len(got)} != {len(want)} extra={str(extra)[:300]} lack={str(lack)[:300]}"
    for a, b in zip(got, want):
        if a != b:
            return f"row\n  spark {str(a)[:700]}\n  sql   {str(b)[:700]}"
    return None
