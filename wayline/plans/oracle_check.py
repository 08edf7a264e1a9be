"""Side-by-side check of a Spark result against a DuckDB oracle query.

Both sides are reduced to rows of normalised text, columns sorted by name,
then compared as multisets (order-insensitive), which is how the project's
correctness gate compares them.  Used by the tests; DuckDB runs in-process
on the same Parquet files and opens no port.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
from collections import Counter

from wayline.sources.views import BASE_TABLES


def duckdb_connect(data_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else "NaN"
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (_dt.date,)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def rows_from_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_from_duckdb(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def digest(rows) -> str:
    h = hashlib.sha256()
    for r in sorted(rows):
        h.update("\x1f".join(r).encode())
        h.update(b"\x1e")
    return h.hexdigest()


def compare(spark_df, con, sql) -> dict:
    s_cols, s_rows = rows_from_spark(spark_df)
    o_cols, o_rows = rows_from_duckdb(con, sql)
    out = {
        "spark_rows": len(s_rows), "oracle_rows": len(o_rows),
        "columns_match": s_cols == o_cols, "spark_cols": s_cols, "oracle_cols": o_cols,
    }
    out["values_match"] = out["columns_match"] and digest(s_rows) == digest(o_rows)
    if not out["values_match"] and out["columns_match"]:
        sc, oc = Counter(s_rows), Counter(o_rows)
        out["only_spark"] = list((sc - oc).elements())[:3]
        out["only_oracle"] = list((oc - sc).elements())[:3]
    return out
