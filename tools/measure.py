"""Per-query wall time (median of N after a warm-up), input rows and shuffle
bytes, read from Spark's event log in a scratch folder.

usage: python tools/measure.py <sf_dir> <scratch_dir> [repeat]
Prints one JSON object {query: {"sec": .., "input_rows": .., "shuffle_bytes": ..}}.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_events(folder: str):
    import zstandard

    files = [f for f in glob.glob(os.path.join(folder, "**", "*"), recursive=True)
             if os.path.isfile(f) and not os.path.basename(f).startswith((".", "appstatus"))]
    for f in sorted(files):
        with open(f, "rb") as fh:
            raw = fh.read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        for line in raw.decode().splitlines():
            if line.strip():
                yield json.loads(line)


def main(argv):
    sf_dir, scratch = argv[1], argv[2]
    repeat = int(argv[3]) if len(argv) > 3 else 3
    from wavepanel.plans.catalog import QUERIES
    from wavepanel.session import get_session

    spark = get_session("local[8]", 8, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": scratch,
        "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB"})
    sc = spark.sparkContext
    QUERIES["frequency_all_questions"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    secs = {}
    for name, fn in QUERIES.items():
        runs = []
        for i in range(repeat):
            sc.setJobGroup(f"{name}#{i}", name)
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        secs[name] = statistics.median(runs)
    sc.setJobGroup("done", "done")
    spark.stop()
    metrics = parse(scratch, repeat)
    out = {n: {"sec": round(s, 3), **metrics.get(n, {"input_rows": 0, "shuffle_bytes": 0})}
           for n, s in secs.items()}
    print(json.dumps(out))


def parse(scratch: str, repeat: int) -> dict:
    """Input rows and shuffle bytes written per query (its last run)."""
    stage_job, metrics = {}, {}
    for e in read_events(scratch):
        if e["Event"] == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id", "")
            for sid in e["Stage IDs"]:
                stage_job[sid] = g
        elif e["Event"] == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            g = stage_job.get(info["Stage ID"], "")
            if not g.endswith(f"#{repeat - 1}"):
                continue
            acc = {a["Name"]: a.get("Value", 0) for a in info.get("Accumulables", [])}
            m = metrics.setdefault(g.split("#")[0], {"input_rows": 0, "shuffle_bytes": 0})
            m["input_rows"] += int(acc.get("internal.metrics.input.recordsRead", 0) or 0)
            m["shuffle_bytes"] += int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0)
    return metrics


if __name__ == "__main__":
    main(sys.argv)
