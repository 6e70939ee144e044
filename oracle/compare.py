"""Local stand-in for the driver's correctness gate.

Runs a Spark query and its oracle SQL (DuckDB over the raw test tables, which
are registered as views) and compares row count, column names, value kinds
and an order-insensitive multiset of normalised rows.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb

RAW = ("region nation customer supplier part orders lineitem events documents "
       "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, decimal.Decimal):
        return ("n", format(v.normalize(), "f") if v == v else "nan")
    if isinstance(v, int):
        return ("n", str(v))
    if isinstance(v, float):
        if v != v:
            return None
        return ("n", format(decimal.Decimal(repr(v)).normalize(), "f")) \
            if abs(v) < 1e15 and v == round(v, 6) else ("f", f"{v:.12g}")
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    if isinstance(v, dict):
        return ("s", tuple(_norm(x) for x in v.values()))
    if hasattr(v, "asDict"):
        return ("s", tuple(_norm(x) for x in v))
    if isinstance(v, (list, tuple)):
        return ("a", tuple(_norm(x) for x in v))
    return ("str", str(v))


def _kind(values) -> str:
    for v in values:
        n = _norm(v)
        if n is not None:
            return n[0] if n[0] != "f" else "n"
    return "null"


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    if not out["columns_match"]:
        out["spark_only"] = sorted(set(s_cols) - set(d_cols))
        out["oracle_only"] = sorted(set(d_cols) - set(s_cols))
        out["match"] = False
        return out
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    s_norm = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=repr)
    d_norm = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=repr)
    kinds = {}
    for k, (a, b) in enumerate(zip(si, di)):
        ks, kd = _kind(r[a] for r in s_rows), _kind(r[b] for r in d_rows)
        if ks != kd and "null" not in (ks, kd):
            kinds[order[k]] = (ks, kd)
    out["kind_mismatch"] = kinds
    out["values_match"] = s_norm == d_norm
    if not out["values_match"]:
        bad = [order[k] for k in range(len(order))
               if sorted((r[k] for r in s_norm), key=repr) != sorted((r[k] for r in d_norm), key=repr)]
        out["bad_columns"] = bad
        for k, c in enumerate(order):
            if c in bad[:3]:
                sv = sorted((r[k] for r in s_norm), key=repr)
                dv = sorted((r[k] for r in d_norm), key=repr)
                diff = [(x, y) for x, y in zip(sv, dv) if x != y][:3]
                out.setdefault("examples", {})[c] = diff
    out["match"] = out["values_match"] and out["spark_rows"] == out["oracle_rows"] and not kinds
    return out
