"""Questionnaire exports delivered as CSV files.

``read_exports`` takes the files as they come: each with its own header, in
its own column order, some with columns that others lack, cells quoted or not.
``load_wide`` merges a new and an old export by the family key, and can guard
the key in the same pass (T26).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.lineage import cut_lineage

#: Where a malformed record's text goes while the files are parsed.
_CORRUPT = "_corrupt_record"
#: Headers looked up at a time.
_LOOKUPS = 16


def csv_options(sep: str = ",") -> dict:
    """How exports are written: a header, cells quoted where needed (and then
    with separators, doubled quotes and line breaks), an empty cell for null,
    nothing trimmed."""
    return dict(header=True, sep=sep, nullValue="", quote='"', escape='"', multiLine=True, enforceSchema=False,
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


class Exports(NamedTuple):
    """Rows of all files by column name, and the malformed records."""

    rows: DataFrame
    bad: DataFrame


def export_files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files under a path, sorted (a listing: contents are not read)."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return sorted(r.path for r in listing.select("path").collect())


def file_header(spark: SparkSession, file: str, sep: str = ",") -> tuple[str, ...]:
    """The column names in a file's first record; an empty file has none."""
    first = spark.read.options(**csv_options(sep) | {"header": False, "mode": "PERMISSIVE"}).csv(file).head()
    names = tuple(first) if first is not None else ()
    if None in names or len(set(names)) < len(names):
        raise ValueError(f"unnamed or repeated columns in the header of {file}: {names}")
    return names


def headers(spark: SparkSession, files: Sequence[str], sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """Files by their header, in the order of the files.  One small job for
    each file reads its first record, several at a time."""
    with ThreadPoolExecutor(_LOOKUPS) as pool:
        found = list(pool.map(lambda f: file_header(spark, f, sep), files))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for names, file in zip(found, files):
        if names:
            by_header.setdefault(names, []).append(file)
    return by_header


def read_exports(spark: SparkSession, path: str | Sequence[str], sep: str = ",", mode: str = "FAILFAST",
                 observation: Observation | None = None) -> Exports:
    """All files under ``path`` as one export; every cell a string.

    Files are grouped by header and each group is read with its own columns,
    so values go by name, never by place; a column that a file lacks is null
    there.  Columns come in the order of their first appearance.

    A record with too few or too many cells fails the job (``FAILFAST``) or,
    with ``PERMISSIVE``, is split off into ``bad`` (file, record): the files
    are then parsed once, into a table in the shared folder that both frames
    read, and ``observation`` gets n_records and n_bad from that pass.  A file
    without a header gives no rows.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")
    by_header = headers(spark, export_files(spark, path), sep)
    if not by_header:
        raise ValueError(f"no file with a header under {path}")
    if any(_CORRUPT in names or "_file" in names for names in by_header):
        raise ValueError(f"an export cannot have a column {_CORRUPT} or _file")
    parsed = None
    for names, files in by_header.items():
        schema = StructType([StructField(n, StringType(), True) for n in names])
        if mode == "PERMISSIVE":
            schema = schema.add(_CORRUPT, StringType(), True)
        group = (spark.read.options(**csv_options(sep), mode=mode, columnNameOfCorruptRecord=_CORRUPT)
                 .schema(schema).csv(files))
        if mode == "PERMISSIVE":
            group = group.withColumn("_file", F.col("_metadata.file_path"))
        parsed = group if parsed is None else parsed.unionByName(group, allowMissingColumns=True)
    columns = list(dict.fromkeys(n for names in by_header for n in names))
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    if mode == "FAILFAST":
        rows = parsed.select(*quoted)
        bad = spark.createDataFrame([], "file string, record string")
        return Exports(rows if observation is None else rows.observe(
            observation, F.count(F.lit(1)).alias("n_records"), F.lit(0).cast("long").alias("n_bad")), bad)
    if observation is not None:
        parsed = parsed.observe(observation, F.count(F.lit(1)).alias("n_records"), F.count(_CORRUPT).alias("n_bad"))
    stored = cut_lineage(parsed)
    return Exports(stored.filter(F.col(_CORRUPT).isNull()).select(*quoted),
                   stored.filter(F.col(_CORRUPT).isNotNull()).select(F.col("_file").alias("file"),
                                                                     F.col(_CORRUPT).alias("record")))


def _key(key: str) -> F.Column:
    return F.col("`" + key.replace("`", "``") + "`")


def _per_key(df: DataFrame, key: str) -> DataFrame:
    """(key, _n, _row, _differ): rows of each key, the smallest of them, and
    whether they differ.  Copies collapse before the shuffle."""
    rest = F.struct(*[_key(c) for c in df.columns if c != key], F.lit(0).alias("_none"))
    return (df.filter(_key(key).isNotNull()).groupBy(_key(key))
            .agg(F.count(F.lit(1)).alias("_n"), F.min(rest).alias("_row"), F.max(rest).alias("_last"))
            .select(_key(key), "_n", "_row", (~F.col("_row").eqNullSafe(F.col("_last"))).alias("_differ")))


_METRICS = lambda: [F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                    F.count_if(F.col("_n") > 1).alias("n_duplicate_keys"), F.count_if("_differ").alias("n_conflicting_keys")]


def guard_key(df: DataFrame, key: str, on_duplicates: str, side: str = "export",
              observation: Observation | None = None) -> DataFrame:
    """``df`` with its key checked on the way, by the shuffle that a join on
    the key needs anyway.

    ``allow``: as it is.  ``fail``: a key that occurs twice ends the job with
    an error that names it.  ``report``: one row per key goes on, the smallest
    by its columns in turn, and ``observation`` gets n_rows, n_keys,
    n_duplicate_keys and n_conflicting_keys (whose rows differ); copies of a
    key collapse before the shuffle, so a key that holds a third of all rows
    is a few rows from each task.  Rows without a key cannot be joined and
    are left out by ``fail`` and ``report``.
    """
    if on_duplicates == "allow":
        return df
    if on_duplicates == "fail":
        n = F.count(F.lit(1)).over(Window.partitionBy(_key(key)))
        message = F.concat(F.lit(f"duplicate {key} in the {side}: "), _key(key).cast("string"))
        once = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        return df.filter(_key(key).isNotNull()).withColumn("_n", n).filter(once).drop("_n")
    if on_duplicates != "report":
        raise ValueError("on_duplicates must be allow, fail or report")
    per = _per_key(df, key)
    if observation is not None:
        per = per.observe(observation, *_METRICS())
    return per.select(*[_key(c) if c == key else F.col("_row." + "`" + c.replace("`", "``") + "`").alias(c)
                        for c in df.columns])


def key_report(df: DataFrame, key: str) -> DataFrame:
    """One row: n_rows, n_keys, n_duplicate_keys, n_conflicting_keys of rows with a key."""
    return _per_key(df, key).agg(*_METRICS())


def duplicate_keys(wide: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once (a data check; aggregated, never collected)."""
    return wide.groupBy(key).count().filter(F.col("count") > 1)


def load_wide(new: DataFrame, old: DataFrame, key: str, on_duplicates: str = "allow",
              observe: Mapping[str, Observation] | None = None) -> DataFrame:
    """B1: merge two exports of the same families (inner join on ``key``).

    Columns present in both come from ``new``; ``old`` only contributes the
    columns that vanished from the new export.  Families missing from either
    export drop out, as in an inner join.  Duplicate keys multiply
    (``allow``), fail or are reported, see ``guard_key``; ``observe`` may
    have an Observation for "new" and "old".
    """
    observe = observe or {}
    old_only = [c for c in old.columns if c == key or c not in set(new.columns)]
    left = guard_key(new, key, on_duplicates, "new export", observe.get("new"))
    right = guard_key(old.select(*[_key(c) for c in old_only]), key, on_duplicates, "old export", observe.get("old"))
    return left.join(right, key, "inner")
