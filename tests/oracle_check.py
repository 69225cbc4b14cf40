"""Run registered queries against their DuckDB oracle (like the driver's gate).

usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "__float__") and type(v).__name__ == "Decimal":
        return f"{round(float(v), 6):.6f}"
    if isinstance(v, bool):
        return str(v)
    return repr(v) if not isinstance(v, (int, str)) else str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a]
    import __spark_entry__ as entry
    from clickrank.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8, driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {str(exc).splitlines()[0][:200]}")
            failed += 1
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"{name:28s} rows={len(rows):8d} (no oracle) spark={t1 - t0:.1f}s")
            continue
        try:
            res = con.execute(sqls[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"{name:28s} ORACLE ERROR {str(exc).splitlines()[0][:300]}")
            failed += 1
            continue
        ok_cols = sorted(cols) == sorted(ocols)
        ok_n = len(rows) == len(orows)
        ok_v = ok_cols and digest(cols, rows) == digest(ocols, orows)
        status = "OK" if ok_cols and ok_n and ok_v else "MISMATCH"
        failed += status != "OK"
        print(f"{name:28s} {status:8s} rows={len(rows):8d}/{len(orows):8d} cols={'ok' if ok_cols else (cols, ocols)} "
              f"spark={t1 - t0:.1f}s")
        if status != "OK" and ok_cols:
            order = sorted(range(len(cols)), key=lambda i: cols[i])
            oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
            a = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
            b = sorted("|".join(_norm(r[i]) for i in oorder) for r in orows)
            sa, sb = set(a), set(b)
            print("   spark-only:", sorted(sa - sb)[:4])
            print("   oracle-only:", sorted(sb - sa)[:4])
    print("FAILED" if failed else "ALL OK", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
