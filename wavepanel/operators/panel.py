"""First and last wave of each family, and the FIRST/LAST panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.answers import is_answered, percent
from ..plans.survey import MIN_GAP, NA
from .reshape import ColumnSpec


def family_waves(long: DataFrame, anchor: str, min_gap: int = MIN_GAP, na: str = NA) -> DataFrame:
    """Per family the first and last wave with an answered anchor question.

    One partial/final aggregate (min and max together); families whose
    last - first < ``min_gap`` (and families without an anchor) are dropped.
    """
    return (long.filter((F.col(S.QUESTION) == F.lit(anchor)) & (F.col(S.ANSWER) != F.lit(na)))
            .groupBy(S.FAMILY)
            .agg(F.min(S.TIME).alias(S.TIME_FIRST), F.max(S.TIME).alias(S.TIME_LAST))
            .filter(F.col(S.TIME_LAST) - F.col(S.TIME_FIRST) >= F.lit(min_gap)))


def first_last_wave(long: DataFrame, anchor: str, min_gap: int = MIN_GAP, na: str = NA,
                    colocated: bool = False) -> DataFrame:
    """Long rows of the kept families, with ``time_first``/``time_last``.

    The per-family bounds are small next to the long table: AQE broadcasts
    them when they fit its (runtime-measured) threshold.  Otherwise the join
    is a sort-merge join, and a family holding a large share of the rows must
    not land in one task.  AQE splits such a skewed partition only when both
    join inputs arrive through their own shuffle; the bounds, already
    partitioned by family by their aggregate, would be joined as they are.
    So the join key is ``family || '\\0'`` - equal exactly when the families
    are equal, but not the aggregate's key - and both sides are shuffled on
    it (the bounds side is one row per family), which lets AQE split the
    hot family's rows over several tasks and replicate its single bounds row.

    ``colocated``: the long table is stored in buckets of the family
    (``write_bucketed``); aggregate and join then read each bucket where it
    lies, without any shuffle.
    """
    bounds = family_waves(long, anchor, min_gap, na)
    if colocated:
        return long.join(bounds.hint("merge"), S.FAMILY, "inner")
    return join_bounds(long, bounds)


def join_bounds(long: DataFrame, bounds: DataFrame) -> DataFrame:
    """Long rows of the families in ``bounds`` (family, time_first, time_last),
    joined on a key that AQE can split, see ``first_last_wave``."""
    key = "_family_key"
    joined_on = F.concat(F.col(S.FAMILY).cast("string"), F.lit("\u0000"))
    bounds = bounds.select(joined_on.alias(key), S.TIME_FIRST, S.TIME_LAST)
    return long.withColumn(key, joined_on).join(bounds, key, "inner").drop(key)


def waves_from_wide(wide: DataFrame, column_map: Sequence[ColumnSpec], anchor: str,
                    min_gap: int = MIN_GAP, na: str = NA, key: str | None = None) -> DataFrame:
    """B10 on the export itself: a wide row holds all waves of one family, so
    first/last wave are a projection (no shuffle).  Same result as
    ``family_waves`` on the exploded long table: a raw cell yields an
    answered anchor row exactly when it is neither null nor 'NA'.

    With ``key`` a family may have several rows: its waves are then the first
    and last of all of them, by an aggregate on the key joined back."""
    present = set(wide.columns)
    anchor_cells = [c for c in column_map if c.question == anchor and c.original_column in present]
    if not anchor_cells:
        raise ValueError(f"anchor question {anchor!r} has no column in the export")

    def wave_if_answered(c: ColumnSpec):
        return F.when(is_answered(F.col(f"`{c.original_column}`").cast("string"), na), F.lit(c.time))

    waves = [wave_if_answered(c) for c in anchor_cells]
    first = F.least(*waves) if len(waves) > 1 else waves[0]
    last = F.greatest(*waves) if len(waves) > 1 else waves[0]
    waves = {S.TIME_FIRST: first.cast("int"), S.TIME_LAST: last.cast("int")}
    long_enough = F.col(S.TIME_LAST) - F.col(S.TIME_FIRST) >= F.lit(min_gap)
    if key is None:
        return wide.withColumns(waves).filter(long_enough)
    bounds = (wide.select(key, *[c.alias(name) for name, c in waves.items()]).groupBy(key)
              .agg(F.min(S.TIME_FIRST).alias(S.TIME_FIRST), F.max(S.TIME_LAST).alias(S.TIME_LAST)).filter(long_enough))
    return wide.join(bounds, key, "inner").select(*wide.columns, S.TIME_FIRST, S.TIME_LAST)


def panel_first_last(periods: DataFrame) -> DataFrame:
    """Rows at each family's first and last wave, ``time`` = FIRST/LAST.

    One pass; the wave number is kept as ``wave``.  A row whose first and last
    wave coincide (only possible with min_gap 0) appears under both tags.
    """
    at_first = F.col(S.TIME) == F.col(S.TIME_FIRST)
    at_last = F.col(S.TIME) == F.col(S.TIME_LAST)
    tags = (F.when(at_first & at_last, F.array(F.lit(S.FIRST), F.lit(S.LAST)))
            .when(at_first, F.array(F.lit(S.FIRST)))
            .when(at_last, F.array(F.lit(S.LAST))))  # literal arrays, no lambda: stays in codegen
    cols = [F.col(c) for c in periods.columns if c != S.TIME]
    return (periods.filter((F.col(S.TIME) == F.col(S.TIME_FIRST)) | (F.col(S.TIME) == F.col(S.TIME_LAST)))
            .select(*cols, F.col(S.TIME).alias(S.WAVE), F.explode(tags).alias(S.TIME)))


def period_distribution(periods: DataFrame) -> DataFrame:
    """Families per (time_first, time_last) and their share of all families.

    The share's denominator is the sum over at most 16 cells, so the global
    window runs on the already reduced frame.
    """
    counts = (periods.groupBy(S.TIME_FIRST, S.TIME_LAST)
              .agg(F.countDistinct(S.FAMILY).alias("count")))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("percentage", F.round(percent(F.col("count"), total), 2))


def respondents_by_territory(panel: DataFrame, by: Sequence[str] = (S.TERRITORY,)) -> DataFrame:
    """Distinct families per territory (or any other key list)."""
    return panel.groupBy(*by).agg(F.countDistinct(S.FAMILY).alias("n_families"))


def one_answer_per_family(panel: DataFrame, order_col: str = S.ANSWER) -> tuple[DataFrame, DataFrame]:
    """One answer per (family, question, time) and the conflicts.

    Returns (rows, conflicts).  ``rows`` keeps the smallest ``order_col``
    (a total order, so the pick is deterministic) and the number of distinct
    answers; ``conflicts`` lists the groups that had more than one.
    """
    keys = [S.FAMILY, S.QUESTION, S.TIME]
    rows = (panel.groupBy(*keys)
            .agg(F.min_by(S.ANSWER, F.struct(F.col(order_col), F.col(S.ANSWER))).alias(S.ANSWER),
                 F.countDistinct(S.ANSWER).alias("n_answers")))
    conflicts = rows.filter(F.col("n_answers") > 1)
    return rows, conflicts


def profile_conflicts(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Keys whose profile columns take more than one combination of values
    (each would count once per combination in a per-family distinct).
    One aggregate; returns (key, n_profiles)."""
    profile = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(key).agg(F.countDistinct(profile).alias("n_profiles"))
            .filter(F.col("n_profiles") > 1))
