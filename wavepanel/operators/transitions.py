"""First -> last answer of each family.

A family's FIRST and LAST rows are brought together by one aggregate on
(family, question) with conditional columns instead of a self-join: no
second scan, partial aggregation on the map side, and a hot family is still
spread over its (family, question) keys.  Questions are single-answer here;
of several answers at one wave the smallest counts, ``n_first``/``n_last``
and the matrix's ``n_conflicts`` show such families (see
``one_answer_per_family`` for the full conflict report).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.answers import as_number, collapse, percent
from ..plans.dictionaries import bounded
from ..plans.lineage import cut_lineage
from ..plans.survey import NA
from .quantiles import same_group
from .recode import VARIANT, recode_answers


def _at(tag: str, value: F.Column) -> F.Column:
    return F.min(F.when(F.col(S.TIME) == F.lit(tag), value))


def _n_at(tag: str) -> F.Column:
    return F.count(F.when(F.col(S.TIME) == F.lit(tag), F.lit(1)))


def transition_pairs(panel: DataFrame, questions: Sequence[str] | None = None,
                     recode: DataFrame | None = None, order: DataFrame | None = None,
                     dims: Sequence[str] = (), variant: int = 0) -> DataFrame:
    """(family, question[, dims], first_answer, last_answer).

    Families with a FIRST answer are kept; a missing LAST answer is null.
    With ``order`` (question, variant, answer, rank) the pair is kept only
    when the last answer is listed in the question's order (an inner join,
    which also drops absent last answers).  Dimension values are taken at
    the FIRST wave.
    """
    df = panel
    if questions is not None:
        df = df.filter(F.col(S.QUESTION).isin(list(questions)))
    if recode is not None:
        df = recode_answers(df, recode, variant).drop(VARIANT)
    pairs = (df.groupBy(S.FAMILY, S.QUESTION)
             .agg(*[_at(S.FIRST, F.col(d)).alias(d) for d in dims],
                  _at(S.FIRST, F.col(S.ANSWER)).alias("first_answer"),
                  _at(S.LAST, F.col(S.ANSWER)).alias("last_answer"),
                  _n_at(S.FIRST).alias("n_first"), _n_at(S.LAST).alias("n_last"))
             .filter(F.col("n_first") > 0))
    if order is not None:
        listed = bounded(order, order.filter(F.col(VARIANT) == F.lit(variant))
                         .select(S.QUESTION, F.col(S.ANSWER).alias("last_answer")).distinct())
        pairs = pairs.join(listed, [S.QUESTION, "last_answer"], "inner")
    return pairs.select(S.FAMILY, S.QUESTION, *dims, "first_answer", "last_answer", "n_first", "n_last")


def transition_matrix(pairs: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Flow counts per (question[, dims], first_answer, last_answer) and
    the share of the first answer's families that moved to each last answer.
    ``n_conflicts`` of the n families had several answers at a wave."""
    keys = [S.QUESTION, *dims, "first_answer", "last_answer"]
    several = (F.col("n_first") > 1) | (F.col("n_last") > 1)
    counts = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(several).alias("n_conflicts"))
    row = [S.QUESTION, *dims, "first_answer"]
    totals = counts.groupBy(*row).agg(F.sum("n").alias("_total"))
    return same_group(counts, totals, row).select(
        *keys, "n", percent(F.col("n"), F.col("_total")).alias("row_pct"), "n_conflicts")


#: Answers that one mask holds.
_MASK = 62


def transition_flows(panel: DataFrame, questions: Sequence[str] | None = None, recode: DataFrame | None = None,
                     order: DataFrame | None = None, dims: Sequence[str] = (), variant: int = 0) -> DataFrame:
    """B16 for multi-answer questions (J6, T21): every FIRST answer of a
    family flows to every LAST answer of the family.

    Columns: question, dims..., first_answer, last_answer, n (families),
    row_pct (share of the flows that leave the first answer).  A family that
    ticks two answers at FIRST and two at LAST adds one to four flows; an
    answer ticked twice counts once.

    With ``order`` only listed answers take part, and a family without a
    listed LAST answer adds nothing; without it the answers are those that
    occur, and a family without LAST rows flows to null.  Dimension values
    are the smallest at FIRST.

    No rows are joined with rows: a family's answers become bits of masks (by
    one aggregate that collapses in the tasks), equal pairs of masks are
    counted, and only the different pairs are opened into answers.  A family
    with any number of rows is a row from each task.
    """
    df = panel if questions is None else panel.filter(F.col(S.QUESTION).isin(list(questions)))
    if recode is not None:
        df = recode_answers(df, recode, variant).drop(VARIANT)
    if order is not None:
        listed = order.filter(F.col(VARIANT) == F.lit(variant)).select(S.QUESTION, S.ANSWER).distinct()
    else:
        df = cut_lineage(df.select(S.FAMILY, S.QUESTION, S.TIME, S.ANSWER, *dims))
        listed = df.select(S.QUESTION, S.ANSWER).distinct()
    # a row for each answer of a question: a dictionary, not data
    known = cut_lineage(listed.filter(F.col(S.ANSWER).isNotNull()).withColumn(
        "_bit", F.row_number().over(Window.partitionBy(S.QUESTION).orderBy(S.ANSWER)) - 1))
    words = known.agg(F.coalesce(F.max("_bit"), F.lit(0)).alias("b")).first()["b"] // _MASK + 1
    bit = F.expr(f"shiftleft(1L, cast(_bit % {_MASK} as int))")
    mask = lambda tag, w: F.coalesce(F.bit_or(F.when(
        (F.col(S.TIME) == F.lit(tag)) & (F.floor(F.col("_bit") / _MASK) == w), bit)), F.lit(0).cast("long"))
    masks = {f"_{tag}{w}": mask(tag, w) for tag in (S.FIRST, S.LAST) for w in range(words)}
    vectors = (df.join(known, [S.QUESTION, S.ANSWER])
               .groupBy(S.FAMILY, S.QUESTION).agg(*[_at(S.FIRST, F.col(d)).alias(d) for d in dims],
                                                  *[m.alias(name) for name, m in masks.items()])
               .groupBy(S.QUESTION, *dims, *masks).agg(F.count(F.lit(1)).alias("_n")))

    def is_set(tag: str) -> F.Column:
        of_word = " ".join(f"when {w} then _{tag}{w}" for w in range(words))
        return F.expr(f"getbit(case cast(floor(_bit / {_MASK}) as int) {of_word} end, cast(_bit % {_MASK} as int)) = 1")

    firsts = vectors.join(known, S.QUESTION).filter(is_set(S.FIRST)).withColumnRenamed(S.ANSWER, "first_answer").drop("_bit")
    lasts = (firsts.join(known, S.QUESTION).filter(is_set(S.LAST))
             .select(S.QUESTION, *dims, "first_answer", F.col(S.ANSWER).alias("last_answer"), "_n"))
    if order is None:
        none = F.lit(True)
        for w in range(words):
            none = none & (F.col(f"_{S.LAST}{w}") == 0)
        lasts = lasts.unionByName(firsts.filter(none).select(S.QUESTION, *dims, "first_answer",
                                                             F.lit(None).cast("string").alias("last_answer"), "_n"))
    flows = lasts.groupBy(S.QUESTION, *dims, "first_answer", "last_answer").agg(F.sum("_n").alias("n"))
    row = [S.QUESTION, *dims, "first_answer"]
    totals = flows.groupBy(*row).agg(F.sum("n").alias("_total"))
    return same_group(flows, totals, row).select(*row, "last_answer", "n", percent(F.col("n"), F.col("_total")).alias("row_pct"))


def grouped_transitions(panel: DataFrame, question: str, dimension: str,
                        recode: DataFrame | None = None, order: DataFrame | None = None,
                        groups: Mapping[str, Sequence[str]] | None = None, other: str | None = None,
                        exclude: Sequence[str] | None = None, variant: int = 0,
                        keep_missing: bool = True) -> DataFrame:
    """B16 of one question split by a profile dimension.

    Answers are recoded first; the dimension may be collapsed into groups
    ({group: [values]}, the rest -> ``other``), and ``exclude`` removes
    values (a null dimension is removed too, as ``NOT IN`` is null on null).
    ``keep_missing=False`` lets ``other`` also absorb null and 'NA' (the
    original notebooks' behaviour).
    """
    df = panel.filter(F.col(S.QUESTION) == F.lit(question))
    if groups:
        df = df.withColumn(dimension, collapse(dimension, groups, other, keep_missing=keep_missing))
    if exclude:
        df = df.filter(~F.col(dimension).isin(list(exclude)))
    pairs = transition_pairs(df, recode=recode, order=order, dims=[dimension], variant=variant)
    return transition_matrix(pairs, dims=[dimension])


def paired_scores(panel: DataFrame, question: str, na: str = NA) -> DataFrame:
    """Numeric (first, last) score per family for one question.

    Families whose FIRST answer is 'NA' are left out; a LAST answer that is
    missing or not a number gives a null ``answer_last`` (never an error).
    Of several answers at a wave the smallest number counts (by value, not
    by spelling); ``n_first`` and ``n_last`` are the answers there were.
    """
    df = panel.filter(F.col(S.QUESTION) == F.lit(question))
    answered = F.when(F.col(S.ANSWER) != F.lit(na), F.lit(1))
    return (df.groupBy(S.FAMILY)
            .agg(_at(S.FIRST, answered).alias("_answered"),
                 _at(S.FIRST, as_number(F.col(S.ANSWER))).alias("answer_first"),
                 _at(S.LAST, as_number(F.col(S.ANSWER))).alias("answer_last"),
                 _n_at(S.FIRST).alias("n_first"), _n_at(S.LAST).alias("n_last"))
            .filter(F.col("_answered").isNotNull())
            .select(S.FAMILY, "answer_first", "answer_last", "n_first", "n_last"))


def paired_scores_summary(scores: DataFrame) -> DataFrame:
    """B18 summary: n, means at FIRST and LAST, mean change, the number of
    families whose pair is not numeric on both ends, and of those with several
    answers at a wave."""
    both = F.col("answer_first").isNotNull() & F.col("answer_last").isNotNull()
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("answer_first").alias("mean_first"),
        F.avg("answer_last").alias("mean_last"),
        F.avg(F.when(both, F.col("answer_last") - F.col("answer_first"))).alias("mean_delta"),
        F.sum(F.when(both, F.lit(0)).otherwise(F.lit(1))).cast("long").alias("n_invalid"),
        F.count_if((F.col("n_first") > 1) | (F.col("n_last") > 1)).alias("n_conflicts"))


__all__ = ["transition_pairs", "transition_matrix", "transition_flows", "grouped_transitions", "paired_scores",
           "paired_scores_summary"]
