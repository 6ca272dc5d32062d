"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet to the shared folder and rereads them as the
next one's input.  The first four return the columns of documents; the last
one has a row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.llm import exact_dedup, langid, mixing, near_dup, packing
from wavepanel.llm.common import cut, documents
from wavepanel.llm.queries import tokenizer_file

#: A document whose best language has a smaller mean probability is rejected.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, without a letter, or with no
    language that fits.  The network is trained on documents that aren't held
    out, as in the query."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    net = langid.fit(docs.select("doc_id", "text", "lang").filter(~held_out))
    found = langid.identify(docs, net)
    return (found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays."""
    return near_dup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it, dealt
    to shards and shuffled there."""
    rows = mixing.mixed_rows(docs)
    # a shard spans several tasks, by the order's range, so none is hot
    parts = (rows.withColumn("_range", F.shiftrightunsigned("_order", 58))
             .repartition("_shard", "_range").sortWithinPartitions("_shard", "_order"))
    return parts.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix packed into sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack)]

#: SQL can't express the trained network, MinHash and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
