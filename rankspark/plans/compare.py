"""Side-by-side check of a Spark query against its DuckDB oracle (used by tests and scripts).

Columns are compared by name (sorted), rows as an order-insensitive multiset.
"""

from __future__ import annotations

import math
from collections import Counter

from rankspark.sources.tables import TABLES


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, con, name: str, build, sql: str, sf_dir: str) -> dict:
    sdf = build(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = [tuple(_norm(x) for x in r) for r in cur.fetchall()]
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows)}
    if sorted(s_cols) != sorted(d_cols):
        out.update(ok=False, reason=f"columns differ: spark={s_cols} oracle={d_cols}")
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    s_proj = Counter(tuple(r[i] for i in order) for r in s_rows)
    d_proj = Counter(tuple(r[d_index[s_cols[i]]] for i in order) for r in d_rows)
    if s_proj == d_proj:
        out.update(ok=True)
        return out
    only_s = list((s_proj - d_proj).elements())[:3]
    only_d = list((d_proj - s_proj).elements())[:3]
    out.update(ok=False, reason=f"values differ; spark-only {only_s} oracle-only {only_d}",
               columns=[s_cols[i] for i in order])
    return out
