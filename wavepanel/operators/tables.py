"""Frequency, missing-answer and descriptive tables.

Every question (and group, flag, level) is a grouping key, so one aggregate
answers what a per-question loop would.  Totals are an aggregate of the
counts, joined back: a question with as many answers as families (an income)
is no hot window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.answers import collapse, percent
from ..plans.dictionaries import bounded
from ..plans.survey import MULTI_ANSWER_QUESTIONS, NA, NA_THRESHOLD, NO, YES
from .quantiles import same_group
from .recode import VARIANT, answer_order, recode_answers


def _one(cond: F.Column) -> F.Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def frequency_table(panel: DataFrame, questions: Sequence[str] | None = None,
                    by: Sequence[str] = (), compare_by: str | None = None,
                    recode: DataFrame | None = None, order: DataFrame | None = None,
                    variant: int | None = 0, filter_by_order: bool = False,
                    denominator: Sequence[str] = (S.TIME,),
                    multi_questions: Sequence[str] = MULTI_ANSWER_QUESTIONS,
                    family_share: bool = False, na: str = NA, weight: str | None = None) -> DataFrame:
    """N and shares of each answer per (question, variant, time[, by][, compare_by]).

    ``pct`` is the share of all rows of the denominator group ((question,
    variant) + ``denominator``, by default the wave, not the territory);
    ``pct_valid`` the share among answered rows (null and ``included=False``
    for 'NA').  ``unit`` says whether rows are families or ticked assertions.
    With ``family_share`` two columns are added for multi-answer questions,
    where a row is an assertion: ``n_families`` (families that gave the
    answer) and ``pct_families`` (their share of the families in the
    denominator group).  ``weight`` names a column that says how many rows a
    row stands for.
    """
    df = panel
    if questions is not None:
        df = df.filter(F.col(S.QUESTION).isin(list(questions)))
    df = recode_answers(df, recode, variant)
    if filter_by_order:
        df = answer_order(df, order, keep_unknown=False)
    extra = list(by) + ([compare_by] if compare_by else [])
    keys = [S.QUESTION, VARIANT, S.TIME] + extra + [S.ANSWER]
    n = F.sum(weight) if weight else F.count(F.lit(1))
    if family_share:  # a row per family and answer, read by both aggregates through one shuffle
        df = df.groupBy(*keys, S.FAMILY).agg(n.alias("_n"))
        counts = df.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count(S.FAMILY).alias("n_families"))
    else:
        counts = df.groupBy(*keys).agg(n.alias("n"))
    answered = F.col(S.ANSWER) != F.lit(na)
    group = [S.QUESTION, VARIANT, *denominator]
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_total"),
                                        F.sum(F.when(answered, F.col("n"))).alias("_valid"))
    unit = F.when(F.col(S.QUESTION).isin(list(multi_questions)), F.lit("responses")).otherwise(F.lit("families"))
    extra_cols = []
    if family_share:
        families = df.groupBy(*group).agg(F.countDistinct(S.FAMILY).alias("_families"))
        totals = same_group(totals, families, group, "left")
        extra_cols = ["n_families", percent(F.col("n_families"), F.col("_families")).alias("pct_families")]
    return same_group(counts, totals, group).select(
        *keys, "n",
        percent(F.col("n"), F.col("_total")).alias("pct"),
        F.when(answered, percent(F.col("n"), F.col("_valid"))).alias("pct_valid"),
        answered.alias("included"),
        unit.alias("unit"), *extra_cols)


def missing_table(panel: DataFrame, questions: DataFrame | None = None,
                  labels: DataFrame | None = None, threshold: float = NA_THRESHOLD,
                  na: str = NA) -> DataFrame:
    """Count and share of 'NA' rows per question at FIRST and LAST.

    Conditional aggregation in one pass (an NA that occurs only at LAST is
    counted).  ``questions`` (a one-column frame) lists the questions to
    report, zero-filled when they have no rows; ``labels`` (question, label)
    adds the label.  ``over_threshold`` flags a share above ``threshold`` %.
    """
    is_na = F.col(S.ANSWER) == F.lit(na)
    first = F.col(S.TIME) == F.lit(S.FIRST)
    last = F.col(S.TIME) == F.lit(S.LAST)
    df = panel
    if questions is not None:
        df = df.join(bounded(questions, questions.select(S.QUESTION)), S.QUESTION, "left_semi")
    agg = df.groupBy(S.QUESTION).agg(
        _one(first & is_na).alias("count_first"), _one(first).alias("rows_first"),
        _one(last & is_na).alias("count_last"), _one(last).alias("rows_last"))
    if questions is not None:
        listed = questions.select(S.QUESTION).distinct()
        agg = listed.join(agg, S.QUESTION, "left")
    out = agg.select(
        S.QUESTION,
        F.coalesce(F.col("count_first"), F.lit(0).cast("long")).alias("count_first"),
        F.coalesce(percent(F.col("count_first"), F.col("rows_first")), F.lit(0.0)).alias("pct_first"),
        F.coalesce(F.col("count_last"), F.lit(0).cast("long")).alias("count_last"),
        F.coalesce(percent(F.col("count_last"), F.col("rows_last")), F.lit(0.0)).alias("pct_last"))
    out = out.withColumn("over_threshold", (F.col("pct_first") > F.lit(float(threshold)))
                         | (F.col("pct_last") > F.lit(float(threshold))))
    if labels is not None:
        out = out.join(bounded(labels, labels.select(S.QUESTION, "label")), S.QUESTION, "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("string"))
    return out.select(S.QUESTION, "label", "count_first", "pct_first", "count_last", "pct_last",
                      "over_threshold")


def frequency_by_flag(panel: DataFrame, question: str, flags: Sequence[str],
                      pairs: Sequence[tuple[str, str]] = (), recode: DataFrame | None = None,
                      yes: str = YES, no: str = NO, na: str = NA, **kwargs) -> DataFrame:
    """B14 of one question within each answered level of each flag, and
    within 'both yes' / 'both no' of each flag pair - one aggregate for all.

    Rows are counted per answer and flags first; the counts are expanded to
    (flag, level) pairs and added up with (flag, level) as keys and as part of
    the share's denominator.  ``family_share`` needs the families and expands
    the rows themselves.
    """
    levels = [F.struct(F.lit(f).alias("flag"), F.col(f).cast("string").alias("level")) for f in flags]
    for a, b in pairs:
        both = (F.when((F.col(a) == F.lit(yes)) & (F.col(b) == F.lit(yes)), F.lit(yes))
                .when((F.col(a) == F.lit(no)) & (F.col(b) == F.lit(no)), F.lit(no)))
        levels.append(F.struct(F.lit(f"{a}&{b}").alias("flag"), both.alias("level")))
    rows = panel.filter(F.col(S.QUESTION) == F.lit(question))
    if not kwargs.get("family_share"):
        kept = dict.fromkeys([S.QUESTION, S.TIME, S.ANSWER, *flags, *[f for pair in pairs for f in pair]])
        rows = rows.groupBy(*kept).agg(F.count(F.lit(1)).alias("_rows"))
        kwargs["weight"] = "_rows"
    df = (rows.select("*", F.inline(F.array(*levels)))
          .filter(F.col("level").isNotNull() & (F.col("level") != F.lit(na))))
    return frequency_table(df, by=["flag", "level"], recode=recode,
                           denominator=[S.TIME, "flag", "level"], na=na, **kwargs)


def descriptive_table(panel: DataFrame, question: str, describe_by: str,
                      recode: DataFrame | None = None, variant: int = 0,
                      groups: Mapping[str, Sequence[str]] | None = None,
                      other: str | None = None, keep_missing: bool = True, na: str = NA) -> DataFrame:
    """Per (answer, group) counts, group totals and shares at FIRST and
    LAST, with the deltas.  Answers are recoded before counting, so a label
    occupies one row; shares are fractions of the group's answered rows."""
    df = recode_answers(panel.filter(F.col(S.QUESTION) == F.lit(question)), recode, variant)
    if groups:
        df = df.withColumn(describe_by, collapse(describe_by, groups, other, keep_missing=keep_missing))
    df = df.filter((F.col(describe_by) != F.lit(na)) & (F.col(S.ANSWER) != F.lit(na)))
    first = F.col(S.TIME) == F.lit(S.FIRST)
    last = F.col(S.TIME) == F.lit(S.LAST)
    counts = df.groupBy(F.col(S.ANSWER), F.col(describe_by).alias("dim")).agg(
        _one(first).alias("count_first"), _one(last).alias("count_last"))
    totals = counts.groupBy("dim").agg(F.sum("count_first").alias("group_total_first"),
                                       F.sum("count_last").alias("group_total_last"))
    out = same_group(counts, totals, ["dim"])
    pct_first = F.coalesce(F.try_divide(F.col("count_first").cast("double"), F.col("group_total_first")), F.lit(0.0))
    pct_last = F.coalesce(F.try_divide(F.col("count_last").cast("double"), F.col("group_total_last")), F.lit(0.0))
    return out.select(
        S.ANSWER, "dim", "count_first", "group_total_first", pct_first.alias("pct_first"),
        "count_last", "group_total_last", pct_last.alias("pct_last"),
        (F.col("count_last") - F.col("count_first")).alias("delta_count"),
        (pct_last - pct_first).alias("delta_pct"))


def assertion_counts(panel: DataFrame, assertions: DataFrame,
                     polarities: Sequence[str] = ("positive", "negative")) -> DataFrame:
    """Number of ticked assertions of each polarity per (family, question, time).

    ``assertions`` is (question, answer, polarity).  Every (family, question,
    time) of a listed question gets one row per polarity, zero when nothing
    of that polarity was ticked (conditional aggregation, no spine join).
    """
    listed = bounded(assertions, assertions.select(S.QUESTION).distinct())
    ticks = bounded(assertions, assertions.select(S.QUESTION, S.ANSWER, "polarity"))
    marked = (panel.join(listed, S.QUESTION, "left_semi")
              .join(ticks, [S.QUESTION, S.ANSWER], "left"))
    counts = marked.groupBy(S.FAMILY, S.QUESTION, S.TIME).agg(
        *[_one(F.col("polarity") == F.lit(p)).alias(f"_n_{i}") for i, p in enumerate(polarities)])
    rows = F.array(*[F.struct(F.lit(p).alias("polarity"), F.col(f"_n_{i}").alias("n"))
                     for i, p in enumerate(polarities)])
    return counts.select(S.FAMILY, S.QUESTION, S.TIME, F.inline(rows))
