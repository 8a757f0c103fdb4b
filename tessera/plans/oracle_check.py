"""Order-insensitive comparison of a Spark result with its DuckDB oracle."""

from __future__ import annotations

import hashlib
import math

from ..session import TABLES


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, bytes):
        return v.hex()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(sdf, con, sql: str) -> list[str]:
    """Problems found (empty when the results agree)."""
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    dcols, drows = rel.columns, rel.fetchall()
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns {scols} vs {dcols}")
    if len(srows) != len(drows):
        problems.append(f"rows {len(srows)} vs {len(drows)}")
    if not problems and digest(scols, srows)[0] != digest(dcols, drows)[0]:
        a, b = digest(scols, srows)[1], digest(dcols, drows)[1]
        problems.append(f"values differ e.g. {[(x, y) for x, y in zip(a, b) if x != y][:1]}"[:500])
    return problems
