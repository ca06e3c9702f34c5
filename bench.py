"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no collect to the driver); the time
includes planning and any small driver-side statistics jobs the query needs. Prints ONE
JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    from rankspark.plans.catalog import load_all
    from rankspark.session import checkpoint_dir, local_session

    spark = local_session(cpus, int(os.environ.get("BENCH_PARTITIONS", "16")), app="rankspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    reg = load_all()

    # warm-up (JVM JIT, codegen caches, Python workers): the flagship once on the
    # smallest tables; not counted
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm_dir):
        reg["int8_borda_map"].build(spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, q in reg.items():
        if only and name not in only:
            continue
        if not only and not q.bench:
            continue
        t0 = time.perf_counter()
        try:
            q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # keep going; report
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{name}: {times.get(name, 'FAILED')}", file=sys.stderr, flush=True)

    out = {
        "metric": "total_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": int(cpus) if str(cpus).isdigit() else cpus,
        "n_queries": len(times),
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
