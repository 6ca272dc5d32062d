"""Configuration dictionaries -> small DataFrames.

The nested-dict form is the one analysts write: for each question either
``{"map": {new: [old, ...]}, "order": [...]}`` or a list of such entries (one
per variant).  Their size is known when they are built, so a frame within
``MAX_BROADCAST_BYTES`` is marked for broadcast (its join never shuffles the
survey data); a larger dictionary is left to a normal shuffle join.  A
frame created from a Python list carries no size statistics of its own, so
without this bound Spark would shuffle the survey side to join it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

# A dictionary of at most this many bytes (as JSON) is broadcast.
MAX_BROADCAST_BYTES = 8 << 20


def small_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A config frame: one JSON literal read in the JVM (no Python worker, one
    call to the JVM for any number of rows), broadcast when its measured size
    is within the bound."""
    names = [f.name for f in _parse_datatype_string(schema).fields]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = "array<struct<" + ",".join(c.strip().replace(" ", ":", 1) for c in schema.split(",")) + ">>"
    df = spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
    if len(text) > MAX_BROADCAST_BYTES:
        return df
    out = F.broadcast(df)
    out._bytes = len(text)
    return out


def bounded(source: DataFrame, derived: DataFrame) -> DataFrame:
    """``derived`` (a projection, filter or distinct of ``source``) keeps the
    source's measured size and thus its broadcast; frames of unknown size
    are returned as they are and left to AQE's size-checked join choice."""
    n = getattr(source, "_bytes", None)
    if n is None:
        return derived
    out = F.broadcast(derived)
    out._bytes = n
    return out


def _variants(entry) -> list[Mapping]:
    return list(entry) if isinstance(entry, (list, tuple)) else [entry]


def recode_frame(spark: SparkSession, answers: Mapping[str, object]) -> DataFrame:
    """(question, variant, old, new) rows from the nested answer dictionary.

    A variant without a map still gets one (question, variant, null, null)
    row, so it exists as a variant; a null ``old`` never matches an answer.
    """
    rows = []
    for q, entry in answers.items():
        for v, e in enumerate(_variants(entry)):
            if not e.get("map"):
                rows.append((q, v, None, None))
            seen = set()
            for new, olds in (e.get("map") or {}).items():
                for old in olds:
                    if old in seen:
                        raise ValueError(f"{q} variant {v}: {old!r} mapped twice")
                    seen.add(old)
                    rows.append((q, v, old, new))
    return small_frame(spark, rows, "question string, variant int, old string, new string")


def order_frame(spark: SparkSession, answers: Mapping[str, object]) -> DataFrame:
    """(question, variant, answer, rank) rows; only entries with an order."""
    rows = []
    for q, entry in answers.items():
        for v, e in enumerate(_variants(entry)):
            for rank, a in enumerate(e.get("order") or []):
                rows.append((q, v, a, rank))
    return small_frame(spark, rows, "question string, variant int, answer string, rank int")


def labels_frame(spark: SparkSession, labels: Mapping[str, str]) -> DataFrame:
    return small_frame(spark, list(labels.items()), "question string, label string")


def questions_frame(spark: SparkSession, questions: Iterable[str]) -> DataFrame:
    return small_frame(spark, [(q,) for q in questions], "question string")


def assertions_frame(spark: SparkSession, polarity: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """(question, answer, polarity) from {polarity: {question: [answers]}}."""
    rows = [(q, a, p) for p, per_q in polarity.items() for q, answers in per_q.items() for a in answers]
    return small_frame(spark, rows, "question string, answer string, polarity string")
