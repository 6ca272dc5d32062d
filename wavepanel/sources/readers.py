"""Readers and writers (B7) and access to the driver's Parquet tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schema as S
from .exports import csv_options, duplicate_keys, load_wide


_SCHEMAS: dict[tuple[str, str], tuple[frozenset, StructType]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables (``<sf_dir>/<name>.parquet``), listed anew
    at each call so that appended files are seen.  The schema, which costs a
    job, is looked up again only when the set of files has changed."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    files, schema = _SCHEMAS.get((spark.sparkContext.applicationId, path), (None, None))
    if schema is not None:
        df = spark.read.schema(schema).parquet(path)
        if frozenset(df.inputFiles()) == files:
            return df
    df = spark.read.parquet(path)
    _SCHEMAS[spark.sparkContext.applicationId, path] = (frozenset(df.inputFiles()), df.schema)
    return df


def read_export_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                    sep: str = ",") -> DataFrame:
    """A questionnaire export as CSV with every column read as a string.

    There is never an inference pass over the data: with ``columns`` the
    schema is given, without it the names come from the header line and
    every column is a string.  Answers stay strings, so the unpivot needs no
    common type and numbers are never re-printed (1e7 would come back as
    '1.0E7').  An empty cell is null.  Cells may be quoted and then hold
    separators, doubled quotes and line breaks; nothing is trimmed.  Files
    whose header differs from the columns asked for (or, without
    ``columns``, from each other) fail instead of swapping values.
    """
    reader = spark.read.options(**csv_options(sep), mode="FAILFAST")
    if columns is None:
        return reader.option("inferSchema", False).csv(path)
    schema = StructType([StructField(c, StringType(), True) for c in columns])
    return reader.schema(schema).csv(path)


def write_long(long: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the tidy table as Parquet partitioned by question, so a
    question filter prunes whole directories, sorted by family inside each
    file for tight row-group statistics.

    ``rebalance`` (not ``repartition``) groups rows by question for the
    writer while letting AQE split a question that holds a large share of
    the rows over several tasks and merge the small ones.
    """
    (long.hint("rebalance", S.QUESTION).sortWithinPartitions(S.QUESTION, S.FAMILY)
     .write.mode(mode).partitionBy(S.QUESTION).parquet(path))


def read_long(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store ``df`` as table ``name`` in ``buckets`` buckets of ``key``,
    sorted by it inside each, and return the table.

    Aggregates and joins on the key then need no shuffle, also between tables
    of the same number of buckets (``load_wide``, ``first_last_wave`` with
    ``colocated``).  Choose the buckets for the data's size (some hundred MB
    each); rows of one key share a bucket, so a key with a large share of the
    rows is better stored by ``write_long``.  A file for each bucket, not for
    each task and bucket: the rows are dealt by the key before the write.
    """
    writer = (df.repartition(buckets, F.col(f"`{key}`")).write.mode("overwrite").format("parquet")
              .bucketBy(buckets, key).sortBy(key))
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def write_export_csv(wide: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A wide export as CSV with a header (empty cell = null), as analysts exchange it."""
    (wide.write.mode(mode).options(header=True, nullValue="", quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                   ignoreTrailingWhiteSpace=False).csv(path))


__all__ = ["table", "read_export_csv", "load_wide", "duplicate_keys", "write_long", "read_long", "write_bucketed",
           "write_export_csv"]
