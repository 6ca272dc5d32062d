"""Answer recoding and ordering.

Dictionaries are DataFrames (``plans.dictionaries`` builds them from the
usual nested-dict form).  They are joined as ordinary equi-joins: Spark
broadcasts them when their (exact, LocalRelation) size is under the
broadcast threshold and falls back to a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.answers import both_yes, lookup
from ..plans.dictionaries import bounded
from ..plans.survey import CATEGORY_ORDER, CATEGORY_PREFIX, NA, NO, YES

VARIANT = "variant"
RANK = "rank"


def recode_answers(df: DataFrame, recode: DataFrame | None, variant: int | None = 0,
                   answer: str = S.ANSWER) -> DataFrame:
    """Many-to-one recode of answers, per question, all questions at once.

    ``recode`` has columns (question, variant, old, new).  The recode is
    simultaneous (a->b, b->c maps [a, b] to [b, c]) and values without an
    entry are kept.  ``variant=None`` returns every variant a question has
    (rows repeat once per variant; questions without entries get variant 0);
    an int keeps that variant only.  Adds the ``variant`` column.
    """
    if recode is None:
        return df.withColumn(VARIANT, F.lit(variant or 0))
    entries = bounded(recode, recode.select(S.QUESTION, VARIANT, F.col("old").alias(answer), F.col("new")))
    if variant is not None:
        out = df.withColumn(VARIANT, F.lit(variant))
    else:
        variants = bounded(recode, recode.select(S.QUESTION, VARIANT).distinct())
        out = (df.join(variants, S.QUESTION, "left")
               .withColumn(VARIANT, F.coalesce(F.col(VARIANT), F.lit(0))))
    out = out.join(entries, [S.QUESTION, VARIANT, answer], "left")
    return out.withColumn(answer, F.coalesce(F.col("new"), F.col(answer))).drop("new")


def _category_rank(answer_col: F.Column) -> F.Column:
    return lookup(answer_col, {a: i for i, a in enumerate(CATEGORY_ORDER)}).cast("int")


def answer_order(df: DataFrame, order: DataFrame | None, keep_unknown: bool = True,
                 category_prefix: str | None = CATEGORY_PREFIX, na: str = NA) -> DataFrame:
    """Ordinal ``rank`` of each answer within its question's declared order.

    ``order`` has columns (question, variant, answer, rank).  Questions whose
    name starts with ``category_prefix`` use the shared category scale; a
    question with no declared order only knows 'NA' (rank 0).  With
    ``keep_unknown=False`` answers outside a declared order are removed (the
    frequency tables' ``filter_by_order``); undeclared questions are kept whole.
    """
    if VARIANT not in df.columns:
        df = df.withColumn(VARIANT, F.lit(0))
    is_category = (F.col(S.QUESTION).startswith(category_prefix) if category_prefix
                   else F.lit(False))
    if order is None:
        declared_rank = F.lit(None).cast("int")
        out = df.withColumn("_declared", F.lit(False))
    else:
        ranks = bounded(order, order.select(S.QUESTION, VARIANT, F.col(S.ANSWER), F.col(RANK).alias("_rank")))
        declared = bounded(order, order.select(S.QUESTION, VARIANT).distinct().withColumn("_declared", F.lit(True)))
        out = (df.join(ranks, [S.QUESTION, VARIANT, S.ANSWER], "left")
               .join(declared, [S.QUESTION, VARIANT], "left"))
        declared_rank = F.col("_rank")
    declared_q = F.coalesce(F.col("_declared"), F.lit(False)) | is_category
    rank = F.coalesce(
        declared_rank,
        F.when(is_category & ~F.coalesce(F.col("_declared"), F.lit(False)), _category_rank(F.col(S.ANSWER))),
        F.when(~declared_q & (F.col(S.ANSWER) == F.lit(na)), F.lit(0)))
    out = out.withColumn(RANK, rank)
    if not keep_unknown:
        out = out.filter(F.col(RANK).isNotNull() | ~declared_q)
    return out.drop("_rank", "_declared")


def in_category_order(df: DataFrame, order: DataFrame | None, keys: tuple[str, ...] = (S.QUESTION, S.TIME)) -> DataFrame:
    """Rows sorted by ``keys`` and then by each answer's declared rank
    (unranked answers last, alphabetically) - the presentation order of the
    tables.  A global sort: use it on aggregated tables, not raw rows."""
    ranked = answer_order(df, order)
    return ranked.orderBy(*keys, F.col(RANK).asc_nulls_last(), F.col(S.ANSWER))


def unrecoded_report(df: DataFrame, order: DataFrame, recode: DataFrame | None = None,
                     variant: int | None = 0) -> DataFrame:
    """Answers (with counts) that a declared order does not list, i.e.
    what ``filter_by_order`` would drop, per (question, variant, time, answer)."""
    ranked = answer_order(recode_answers(df, recode, variant), order, keep_unknown=True)
    declared = bounded(order, order.select(S.QUESTION, VARIANT).distinct())
    return (ranked.join(declared, [S.QUESTION, VARIANT], "left_semi")
            .filter(F.col(RANK).isNull())
            .groupBy(S.QUESTION, VARIANT, S.TIME, S.ANSWER).agg(F.count(F.lit(1)).alias("n")))


def composite_flags(df: DataFrame, name: str, a: str, b: str, yes: str = YES, no: str = NO) -> DataFrame:
    """``name`` = yes when a and b are both yes, no when not, null if undecidable."""
    return df.withColumn(name, both_yes(a, b, yes, no))


def find_values(df: DataFrame, column: str, term: str) -> DataFrame:
    """Distinct values of ``column`` that contain ``term`` (plain substring)."""
    return df.select(F.col(column).alias("value")).filter(F.col("value").contains(term)).distinct()
