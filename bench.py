"""Benchmark the headline queries on one scale factor.

Runs each query to completion with the ``noop`` sink (the whole plan executes,
nothing is collected to the driver) and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_REPEAT (default 3,
best of N: the first runs of a plan also pay code generation and JIT warm-up).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "logistics_regional", "financial_health", "supplier_performance",
    "fact_orders", "fact_reviews", "dim_seller",
    "measures_by_year", "measures_by_seller_segment", "measures_by_category",
    "dq_report", "gate_pk_first_wins", "gate_fk_rejects", "top_categories",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    from mercadia.registry import QUERIES
    from mercadia.session import build_session, checkpoint_dir

    spark = build_session(f"local[{cpus}]", app="mercadia-bench", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": "16g"})
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="mercadia-bench-ckpt-"))
    checkpoint_dir(spark)
    # warm-up: JVM, parquet footers, codegen caches
    QUERIES["order_freight"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times, errors = {}, {}
    for name in names:
        best = None
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)
        except Exception as e:  # noqa: BLE001 - report it, keep measuring the others
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total_wall",
           "value": round(sum(v for v in times.values() if v is not None), 3),
           "unit": "sec", "queries": times,
           "sf": float(m.group(1)) if m else sf_dir,
           "cpus": cpus, "shuffle_partitions": cpus * 2, "repeat": repeat,
           "spark": spark.version}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
