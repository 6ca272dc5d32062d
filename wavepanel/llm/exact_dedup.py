"""Exact dedup: group by a 128-bit content hash, compare the bytes inside
each group, keep one document of every class of equal texts.

1. Each text is normalised (A-Z lower-cased, null as empty) and hashed (MD5,
   128 bits).
2. One aggregate over (hash, normalised text) counts each class and finds
   the id that stays.  The text in the key makes Spark compare the bytes
   inside a hash group, so a collision gives two classes; copies collapse
   before the shuffle (map-side), so a class that holds a third of all rows
   is a few rows per task.
3. The classes carry the SHA-256 of their text, so the text itself goes no
   further.  Documents find their class by the two hashes; AQE splits the
   partition of a hash with many copies.

Rows without a class do not exist: null text counts as empty.  A null id
never wins against another id; a class of null ids only has a null keep_id
and its rows stay.  Rows that repeat the winning id all stay, as nothing
tells them apart.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def md5_128(text: Column) -> Column:
    """The 128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(text))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest",
            content_hash=md5_128) -> DataFrame:
    """One row per class of equal texts: _hash, _sha, keep_id, group_size."""
    pick = {"largest": F.max, "smallest": F.min}[keep]
    rows = docs.select(F.col(doc_id).alias("_id"), normalised(F.col(text)).alias("_text"))
    return (rows.groupBy(content_hash(F.col("_text")).alias("_hash"), "_text")
            .agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .select("_hash", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest",
                content_hash=md5_128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: 'largest' or 'smallest' id of a class.  ``content_hash`` takes
    the normalised text; a weak one only makes more work, never another
    result (tested).
    """
    found = cut(classes(docs, doc_id, text, keep, content_hash), "classes")
    norm = normalised(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), content_hash(norm).alias("_hash"), F.sha2(norm, 256).alias("_sha"))
    return (rows.join(found, ["_hash", "_sha"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("_sha").alias("text_sha256")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = cut(classes(docs, doc_id, text, keep).select(
        F.col("_hash").alias("__hash"), F.col("keep_id").alias("__keep")), "classes")
    hashed = docs.withColumn("__hash", md5_128(normalised(F.col(text))))
    return (hashed.join(found, "__hash")
            .filter(F.col(f"`{doc_id}`").eqNullSafe(F.col("__keep")))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
