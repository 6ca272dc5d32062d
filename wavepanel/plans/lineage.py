"""Lineage cuts: ``cut_lineage`` materialises a frame that several branches read into
the shared checkpoint folder (``spark.checkpoint.dir``), so the branches
read it back instead of recomputing it, and a lost executor costs a re-read,
not a recomputation from the raw tables.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """A path in the shared folder goes when the driver's JVM ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back (one job; an eager ``checkpoint()`` would compute the input twice
    unless it were cached).  The table is deleted when the driver's JVM ends."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    delete_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.parquet(path)
