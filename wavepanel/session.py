"""SparkSession construction and the shared checkpoint folder.

``get_session`` builds a session with the settings that the library relies on
(AQE, UTC, no UI); on a cluster pass the platform's own session to the
operators instead.  ``spark.checkpoint.dir`` is read from the session; a
scratch folder is chosen only on a local master, and a cluster without a
shared folder is an error.
"""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are designed around.  AQE turns size-checked joins
# into broadcasts at run time (the dictionary joins), splits skewed join
# partitions, and coalesces the small post-aggregation partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime-measured sizes only: a per-family side (e.g. first/last wave
    # bounds, a few MB per million families) is broadcast instead of
    # shuffling the long table when AQE sees it is under this size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "wavepanel", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one; otherwise (local
    runs only) creates a fresh scratch folder and records it in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="wavepanel-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def size_for_cluster(spark: SparkSession, total_cores: int, shuffle_bytes: int,
                     task_bytes: int = 256 << 20) -> dict:
    """Partition sizing on ``total_cores`` for jobs whose largest shuffle
    writes ``shuffle_bytes`` (from an earlier run's stage figures; most
    shuffles here follow a partial aggregate and carry far less than a scan).

    Scans are split into ~``task_bytes`` tasks; shuffles start with at least
    3 tasks a core and about ``task_bytes`` each, and AQE coalesces them.
    Map status costs the driver a byte per map and reduce task, so ask for no
    more than the shuffle needs.  Returns the settings applied.
    """
    shuffle = max(3 * total_cores, math.ceil(shuffle_bytes / task_bytes))
    settings = {
        "spark.sql.files.maxPartitionBytes": str(task_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(task_bytes),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * task_bytes),
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    return settings
