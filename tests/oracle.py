"""Runs named queries and their SQL on the same tables and compares them: python tests/oracle.py SF_DIR [NAME...]"""

import glob
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def views(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "NaN" if math.isnan(f) else f"{f:.6g}" if f else "0"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None if equal, else what differs."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    got = df.collect()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        x, y = set(a), set(b)
        return f"{len(a)} rows against {len(b)}; only here {list(x - y)[:3]}; only in SQL {list(y - x)[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e

    from skeinwork.session import get_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con, sql, bad = get_session("oracle", cores=8), views(sf), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            df = f(spark, sf)
            why = compare(df, con, sql[name]) if name in sql else None
            n = df.count() if name not in sql else ""
        except Exception as x:  # noqa: BLE001
            why, n = f"{type(x).__name__}: {str(x)[:600]}", ""
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok' if name in sql else 'rows'} {name} {time.time() - t:.1f}s {n} {why or ''}", flush=True)
    print("failures", bad)
