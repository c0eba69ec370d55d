"""Order-insensitive comparison of a Spark result with the DuckDB oracle (as the driver does)."""

from __future__ import annotations

import hashlib
import math


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(round(v, 9))
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def digest(columns, rows):
    """(hash, sorted lines) of rows with columns taken in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duckdb_views(sf_dir: str):
    """A DuckDB connection with every supplied table registered as a view."""
    import duckdb

    from ..sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql: str):
    """Return (ok, detail) for a Spark DataFrame against oracle SQL."""
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    sh, sl = digest(df.columns, srows)
    oh, ol = digest(ocols, orows)
    same_cols = sorted(df.columns) == sorted(ocols)
    ok = same_cols and len(srows) == len(orows) and sh == oh
    detail = {"rows": (len(srows), len(orows)), "cols": (sorted(df.columns), sorted(ocols))}
    if not ok and same_cols:
        detail["spark_only"] = [x[:200] for x in sorted(set(sl) - set(ol))[:3]]
        detail["oracle_only"] = [x[:200] for x in sorted(set(ol) - set(sl))[:3]]
    return ok, detail
