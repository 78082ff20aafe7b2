"""Run registered queries next to their SQL on the same tables: python tests/check_queries.py [names]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6f}".replace("-0.000000", "0.000000")
        if hasattr(v, "asDict"):
            return cell(list(v.asDict().values()))
        if isinstance(v, dict):
            return cell(list(v.values()))
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(cell(x) for x in v) + "]"
        if type(v).__name__ == "Decimal":
            return f"{float(v):.6f}"
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def compare(spark, con, query, sf_dir):
    """(ok, message, rows, spark seconds)"""
    from fieldtrace.sources.fixtures import Tables
    t0 = time.time()
    df = query.run(Tables(spark, sf_dir))
    got = df.collect()
    sec = time.time() - t0
    if query.sql is None:
        folder = os.path.dirname(os.path.abspath(__file__))
        tests = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("test_"))
        return f'"{query.name}"' in tests, "it has no SQL; a test has to name it", len(got), sec
    cur = con.execute(query.sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got), sec
    want = canonical(cur.fetchall(), cols)
    have = canonical(got, df.columns)
    if have == want:
        kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
                 "TIMESTAMP": "timestamp_ntz", "DATE": "date"}
        types = {c[0]: str(c[1]) for c in cur.description}
        odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if kinds.get(types[c], "?") != t]
        return not odd, "equal" + (f"  types {odd}" if odd else ""), len(got), sec
    only_s = [r for r in have if r not in set(want)][:3]
    only_d = [r for r in want if r not in set(have)][:3]
    return False, f"{len(have)} vs {len(want)} rows\n   spark {only_s}\n   sql   {only_d}", len(got), sec


if __name__ == "__main__":
    from fieldtrace.catalog import all_queries
    from fieldtrace.session import local_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(sf)
    names = sys.argv[1:]
    bad = 0
    for name, q in all_queries().items():
        if names and name not in names:
            continue
        try:
            ok, msg, n, sec = compare(spark, con, q, sf)
        except Exception as e:  # report and go on with the next query
            ok, msg, n, sec = False, f"{type(e).__name__}: {str(e)[:1500]}", -1, 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {n:7d} rows {sec:6.2f}s  {msg}", flush=True)
    print(f"{bad} failed")
