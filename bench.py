"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and fully executed (noop sink, so nothing is collected
to the driver); the time includes plan construction.  One warm-up query
runs first; each query's time is the median of $BENCH_REPEAT runs (default
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from wavepanel.session import get_session
    from wavepanel.plans.catalog import QUERIES

    # Small-SF tuning: let AQE keep ~1 post-shuffle partition per core even
    # when a stage's shuffle output is only a few MB (the default minimum of
    # 1 MB per partition would leave most cores idle in the generate steps).
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus,
                        extra={"spark.driver.memory": "16g",
                               "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB"})
    QUERIES["frequency_all_questions"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name, fn in QUERIES.items():
        runs = []
        for _ in range(repeat):
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        runs.sort()
        times[name] = round(runs[len(runs) // 2], 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
