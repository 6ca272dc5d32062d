"""Exact quantiles without gathering a group in one task.

1. One aggregate per group gives the number of values and, from an
   approximate sketch, a bracket [low, high] around each asked quantile: the
   values at p -/+ 4 / accuracy, where the sketch's rank error is at most
   1 / accuracy, so the exact positions lie inside.  In a group of no more
   than ``accuracy`` values, where a rank is a larger step, the bracket is open.
   Where a bracket may hold more than ``INSIDE`` values, further passes count
   the values below and inside and sketch those inside, which narrows the
   bracket some twentyfold each time (``narrowed``): what is sorted at the end
   does not grow with the data.
2. One more pass counts the values below each bracket (they collapse map-side)
   and keeps only the values inside it, about 4 / accuracy of the group, as
   distinct values with counts.
3. A window over these few rows finds the values at positions floor(h) and
   ceil(h), h = p (n - 1), which are interpolated (SQL ``quantile_cont``).  A
   position outside its bracket would be an error, not a null.

A sketch's merge order, hence its brackets, may differ if it is recomputed
after a lost executor, so the sketch (a row per group) is written once to the
shared folder and all tasks read the same brackets.

Groups with a null key are groups like any other.  Null and NaN values count
as missing; a group without values has null quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage

INTERPOLATIONS = ("linear", "lower", "higher", "nearest", "midpoint")
ACCURACY = 10000
#: Values inside a bracket that one task may sort.
INSIDE = 200_000
#: Steps of the sketch inside a bracket.
_STEPS = 100


def number(value: F.Column) -> F.Column:
    """A value as a double, NaN as null."""
    v = value.cast("double")
    return F.when(~F.isnan(v), v)


def same_group(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the group columns, null equal to null."""
    renamed = right.select(*[F.col(f"`{c}`").alias(f"__{c}") if c in by else F.col(f"`{c}`") for c in right.columns])
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"`__{c}`"))
    return left.join(renamed, on, how).drop(*[f"__{c}" for c in by])


def brackets(x: F.Column, probs: Sequence[float], accuracy: int = ACCURACY) -> list[F.Column]:
    """Aggregates _n and _s (low and high value of each bracket in turn)."""
    at = [min(1.0, max(0.0, p + d / accuracy)) for p in probs for d in (-4.0, 4.0)]
    return [F.count(x).alias("_n"), F.percentile_approx(x, at, accuracy).alias("_s")]


def _with_brackets(vals: DataFrame, sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return same_group(vals, sketch.select(*by, "_n", "_s"), by)
    # one global sketch: scalar subqueries, no join
    return vals.withColumns({"_n": sketch.select("_n").scalar(), "_s": sketch.select("_s").scalar()})


def narrowed(vals: DataFrame, sketch: DataFrame, by: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY,
             inside: int = INSIDE) -> DataFrame:
    """The sketch (by..., _n, _s) with brackets of at most ``inside`` values,
    or of values that repeat so often that they are few different ones.

    Each pass is one aggregate with a row per group and quantile from each
    task.  A group under the bound keeps its brackets, and no pass is made
    if all are."""
    by, steps = list(by), [k / _STEPS for k in range(_STEPS + 1)]
    if (sketch.agg(F.max("_n").alias("n")).first()["n"] or 0) * 8 <= inside * accuracy:
        return sketch
    rest = [c for c in sketch.columns if c not in (*by, "_n", "_s")]
    while True:
        rows = _with_brackets(vals.filter(F.col("_x").isNotNull()), sketch, by)
        low, high = (lambda i: F.get("_s", F.lit(2 * i))), (lambda i: F.get("_s", F.lit(2 * i + 1)))
        few = F.col("_n") <= accuracy
        within = lambda i: few | F.col("_x").between(low(i), high(i))
        aggs = [a for i in range(len(probs)) for a in (
            F.count_if(~few & (F.col("_x") < low(i))).alias(f"_b{i}"), F.count_if(within(i)).alias(f"_m{i}"),
            F.percentile_approx(F.when(within(i), F.col("_x")), steps, accuracy).alias(f"_g{i}"))]
        seen = same_group(sketch, cut_lineage(rows.groupBy(*by).agg(*aggs)), by) if by else sketch.crossJoin(
            F.broadcast(cut_lineage(rows.groupBy().agg(*aggs))))  # one row and one row
        ends = []
        for i, p in enumerate(probs):
            h, m = F.lit(float(p)) * (F.col("_n") - 1), F.col(f"_m{i}")
            at = lambda place: F.greatest(F.lit(0), F.least(F.lit(_STEPS), place)).cast("int")
            first = at(F.floor((F.floor(h) - F.col(f"_b{i}")) / m * _STEPS) - 2)
            last = at(F.ceil((F.ceil(h) - F.col(f"_b{i}") + 1) / m * _STEPS) + 2)
            # the sketch's ends are only nearly the bracket's
            small = few | (m <= inside)
            ends += [F.when(small | (first == 0), low(i)).otherwise(F.get(f"_g{i}", first)),
                     F.when(small | (last == _STEPS), high(i)).otherwise(F.get(f"_g{i}", last))]
        step = cut_lineage(seen.select(*[F.col(f"`{c}`") for c in by], *rest, "_n", F.array(*ends).alias("_s"), F.greatest(
            *[F.when(few | (low(i) == high(i)), F.lit(0)).otherwise(F.col(f"_m{i}")) for i in range(len(probs))],
            F.lit(0)).alias("_most"), (~F.col("_s").eqNullSafe(F.array(*ends))).alias("_moved")))
        state = step.agg(F.max("_most").alias("most"), F.bool_or("_moved").alias("moved")).first()
        sketch = step.drop("_most", "_moved")
        if (state["most"] or 0) <= inside or not state["moved"]:
            return sketch


def from_brackets(vals: DataFrame, sketch: DataFrame, by: Sequence[str], probs: Sequence[float],
                  interpolation: str = "linear", accuracy: int = ACCURACY) -> DataFrame:
    """(by..., p, q) from values (by..., _x) and their brackets (by..., _n, _s)."""
    by = list(by)
    vals = vals.filter(F.col("_x").isNotNull())
    rows = _with_brackets(vals, sketch, by)
    low, high = (lambda i: F.get("_s", F.lit(2 * i))), (lambda i: F.get("_s", F.lit(2 * i + 1)))
    few = F.col("_n") <= accuracy
    of = [F.struct(F.lit(float(p)).alias("p"), F.when(few | (F.col("_x") >= low(i)), F.col("_x")).alias("_v"),
                   (~few & (F.col("_x") > high(i))).alias("_above")) for i, p in enumerate(probs)]
    counts = (rows.select(*by, "_n", "_x", "_s").select(*by, "_n", F.inline(F.array(*of))).filter("not _above")
              .groupBy(*by, "_n", "p", "_v").agg(F.count(F.lit(1)).alias("_c")))
    upto = Window.partitionBy(*by, "p").orderBy(F.col("_v").asc_nulls_first())
    h = F.col("p") * (F.col("_n") - 1)
    placed = (counts.withColumn("_end", F.sum("_c").over(upto) - 1).withColumn("_start", F.col("_end") - F.col("_c") + 1)
              .withColumns({"_h": h, "_lo": F.floor(h), "_hi": F.ceil(h)}))
    at = lambda k: F.max(F.when(F.col(k).between(F.col("_start"), F.col("_end")), F.col("_v")))
    picked = placed.groupBy(*by, "p").agg(at("_lo").alias("_xl"), at("_hi").alias("_xh"), F.max("_h").alias("_h"),
                                          F.max("_lo").alias("_lo"))
    xl, xh, frac = F.col("_xl"), F.col("_xh"), F.col("_h") - F.col("_lo")
    q = {"linear": xl + frac * (xh - xl), "lower": xl, "higher": xh,
         "nearest": F.when(frac >= F.lit(0.5), xh).otherwise(xl), "midpoint": (xl + xh) / F.lit(2.0)}[interpolation]
    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    return picked.select(*by, "p", F.when(xl.isNull() | xh.isNull(), missed).otherwise(q).alias("q"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], accuracy: int = ACCURACY,
                    interpolation: str = "linear", inside: int = INSIDE) -> DataFrame:
    """(by..., p, q): the exact p-quantile of ``value`` per group.

    With h = p (n - 1) and x_lo, x_hi the values at positions floor(h),
    ceil(h): linear = x_lo + (h - floor(h)) (x_hi - x_lo) (SQL quantile_cont),
    lower = x_lo, higher = x_hi, nearest = the value at round(h) (halves
    away from zero), midpoint = (x_lo + x_hi) / 2.
    """
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"interpolation must be one of {INTERPOLATIONS}")
    vals = df.select(*by, number(F.col(value)).alias("_x"))
    aggs = brackets(F.col("_x"), probs, accuracy)
    sketch = narrowed(vals, cut_lineage(vals.groupBy(*by).agg(*aggs)), by, probs, accuracy, inside)
    found = from_brackets(vals, sketch, by, probs, interpolation, accuracy)
    every = sketch.select(*by, F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    return same_group(every, found, [*by, "p"], "left").select(*by, "p", "q")
