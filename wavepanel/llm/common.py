"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and tab..carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: The same words of UTF-8 bytes are what ``bytes.split()`` returns.

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the executors' Python workers, once per
    application, as ``spark-submit --py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "wavepanel"), "zip",
                                      os.path.dirname(package), os.path.basename(package))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)


_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, release: Callable[[], None]) -> None:
    """A Python worker serves one operator after the other; what an earlier
    one remembers (words, tables) is released when another begins."""
    for other in [k for k in _HELD if k != name]:
        _HELD.pop(other)()
    _HELD[name] = release


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``.

    It must be set on a cluster; a local session without it gets a scratch
    folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="wavepanel-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read
    it back.  A lost executor then costs a re-read, and every branch reads
    the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that on ASCII text, much
    faster than ``translate``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """Number of words of ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is read
    (a lambda would otherwise compute it again for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(values: Column, block: int = 64) -> Column:
    """For an array of n numbers the n sums of the elements before each one.

    Done in blocks: sums of blocks, sums before each block, then inside the
    blocks, so the work is n * block + (n / block)**2 instead of n**2.
    """
    def sums(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / block).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(v, b * block + 1, F.lit(block))))
        before = let(blocks, lambda s: F.transform(s, lambda x, b: _sum(F.slice(s, F.lit(1), b))))
        return let(before, lambda s: F.transform(v, lambda x, i: F.get(s, F.floor(i / block).cast("int")) + _sum(
            F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block))))

    return F.when(F.size(values) > 0, let(values, sums)).otherwise(F.array().cast("array<bigint>"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` in ``text``, as an
    array of structs (text, start, end, before, after): the match, its code
    points from start to before end, the piece of text since the match before
    it, and that up to the match after it.

    ``split`` cuts at the same matches, so the starts are running sums of
    the lengths of pieces and matches.  The pattern must not match the
    empty string.
    """
    def spans(v: Column) -> Column:
        found, pieces = v["found"], v["pieces"]
        steps = F.transform(found, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long"))
        return let(prefix_sums(steps), lambda sums: F.transform(found, lambda m, i: F.struct(
            m.alias("text"), (F.get(sums, i) + F.length(F.get(pieces, i))).alias("start"),
            (F.get(sums, i) + F.length(F.get(pieces, i)) + F.length(m)).alias("end"),
            F.get(pieces, i).alias("before"), F.get(pieces, i + 1).alias("after"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                    F.split(text, pattern, -1).alias("pieces"))
    return let(both, spans)


NO_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def pattern_spans(text: Column, kind: str, pattern: str, keep: Callable[[Column], Column] | None = None,
                  needs: Column | None = None) -> Column:
    """Structs (kind, start, end) of the matches that ``keep`` accepts.
    ``needs`` is a cheap test that texts with a match pass; texts without a
    match take a short way."""
    found = matches(text, pattern)
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["text"]))
    spans = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    there = F.rlike(text, F.lit(pattern))
    return F.when(there if needs is None else needs & there, spans).otherwise(F.array().cast(NO_SPANS))


def span_text(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of an array of structs (kind, start, end) by start,
    then kind in the order of ``kinds``, comma-joined."""
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"),
        F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")).alias("text")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["text"]), ",")
