"""Run registered queries in Spark and their oracle SQL in DuckDB; print one line each.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankspark.plans.catalog import load_all  # noqa: E402
from rankspark.plans.compare import compare, duckdb_connection  # noqa: E402
from rankspark.session import local_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_connection(sf_dir)
    reg = load_all()
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        if q.sql is None:
            n = q.build(spark, sf_dir).count()
            print(f"ROWS  {name:28s} rows={n} ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            r = compare(spark, con, name, q.build, q.sql, sf_dir)
        except Exception as e:  # report and go on
            r = {"ok": False, "reason": f"{type(e).__name__}: {str(e)[:400]}", "spark_rows": "?", "oracle_rows": "?"}
        tag = "OK   " if r["ok"] else "FAIL "
        bad += 0 if r["ok"] else 1
        print(f"{tag} {name:28s} rows={r['spark_rows']}/{r['oracle_rows']} ({time.time() - t0:.1f}s)"
              + ("" if r["ok"] else f"\n      {r['reason']}"), flush=True)
    print(f"failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
