"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed fully with the ``noop`` sink (no driver collection),
after a warm-up run of each query on the smallest table set (BENCH_COLD=1 skips it).  Prints one JSON line.
BENCH_ALL=1 times every registered query instead of the headline set; the full
analysis job (26 result tables) is timed separately (BENCH_NO_ANALYSIS=1 skips it).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pricelab.plans import queries as Q  # noqa: E402
from pricelab.plans.session import build_session  # noqa: E402

HEADLINE = [
    "clean_sales", "sku_rollup", "sku_elasticity", "category_elasticity", "sku_meta",
    "segment_stats_channel", "segment_stats_fulfilment", "segment_stats_b2b", "segment_stats",
    "price_pivot", "evaluation_pivot", "price_histogram", "price_density", "revenue_by_month",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = list(Q.QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    shuffle = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, 2 * cpus)))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=shuffle, app="pricelab-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                                 "spark.sql.files.maxPartitionBytes": str(64 << 20)})
    # Steady state: warm the JVM and the generated-code cache on the smallest tables.
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm) and not os.environ.get("BENCH_COLD"):
        for name in names:
            Q.QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    # The whole analysis as one job graph (fact and elasticity tables written once, in the shared folder).
    analysis_sec = None
    if not os.environ.get("BENCH_NO_ANALYSIS"):
        from pricelab.plans.analysis import run_analysis
        from pricelab.plans.session import scratch_path
        from pricelab.sources import raw_sales_from_tables
        t0 = time.perf_counter()
        run_analysis(spark, raw_sales_from_tables(spark, sf_dir), scratch_path(spark, f"bench-{uuid.uuid4().hex}"),
                     order=F.col("order_id") * 1000 + F.col("line_no"))
        analysis_sec = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "headline_total_sec" if names is HEADLINE else "all_queries_total_sec",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
                      "cpus": cpus, "full_analysis_sec": analysis_sec}))
    spark.stop()


if __name__ == "__main__":
    main()
