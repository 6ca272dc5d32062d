"""Association, histograms, per-capita values and group statistics
(B19-B23, B25).

All statistics are aggregates whose results are small (cells, bins,
groups); raw values never leave the executors.  Global bounds (histogram
min/max, totals) are scalar subqueries, not joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.answers import as_number, is_answered, percent, replace_values
from ..plans.survey import MAYBE_AS_YES, NA
from ..plans.lineage import cut_lineage
from ..plans.dictionaries import small_frame
from .quantiles import INTERPOLATIONS, brackets, from_brackets, narrowed, number, same_group


def _v_from_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cramér's V per ``keys`` group from a (keys, v1, v2, o) cell frame.

    chi2 = n * (sum (o / r) * (o / c) - 1) over the observed cells, equal to
    the full-table sum including empty cells, so no pivot is needed; products
    are of doubles, so marginals of any size fit.  Marginals are aggregates
    joined back, not windows, so a frequent value is no hot window.  V = 0
    for fewer than 2 rows, null when a variable has a single level.  With no
    keys the result is one row even for an empty input.
    """
    margin = lambda v, name: cells.groupBy(*keys, v).agg(F.sum("o").cast("double").alias(name))
    with_r = cells.join(margin("v1", "_m1"), [*keys, "v1"])
    both = with_r.join(margin("v2", "_m2"), [*keys, "v2"])
    o = F.col("o").cast("double")
    per = (both.withColumn("_t", (o / F.col("_m1")) * (o / F.col("_m2")))
           .groupBy(*keys).agg(F.coalesce(F.sum("o"), F.lit(0)).alias("n"), F.sum("_t").alias("_s"),
                               F.countDistinct("v1").alias("_r"), F.countDistinct("v2").alias("_c")))
    n = F.col("n").cast("double")
    chi2 = F.greatest(n * (F.col("_s") - F.lit(1.0)), F.lit(0.0))
    k = F.least(F.col("_r"), F.col("_c")) - F.lit(1)
    v = (F.when(F.col("n") < 2, F.lit(0.0))
         .when(k <= 0, F.lit(None).cast("double"))
         .otherwise(F.sqrt(chi2 / (n * k))))
    return per.select(*keys, F.col("n").cast("long").alias("n"), v.alias("cramers_v"))


def cramers_v(df: DataFrame, col1: str, col2: str, na: str = NA) -> DataFrame:
    """Cramér's V of two categorical columns (no Yates, no bias correction).

    Rows with null or 'NA' in either column are ignored.  Returns one row
    (var1, var2, n, cramers_v).
    """
    a = F.col(col1).cast("string")
    b = F.col(col2).cast("string")
    cells = (df.filter(is_answered(a, na) & is_answered(b, na))
             .groupBy(a.alias("v1"), b.alias("v2"))
             .agg(F.count(F.lit(1)).alias("o")))
    return _v_from_cells(cells, []).select(F.lit(col1).alias("var1"), F.lit(col2).alias("var2"),
                                           "n", "cramers_v")


def contingency_table(df: DataFrame, row: str, col: str, values: Sequence[str] | None = None,
                      na: str = NA) -> DataFrame:
    """Counts of (row, col) as a table with one column per category of ``col``
    (for export; the statistics above never pivot).  Empty cells are 0 and
    rows with null/'NA' in either column are ignored, as in ``cramers_v``.
    Without ``values`` Spark first finds the categories (a distinct of one
    column, capped by ``spark.sql.pivotMaxValues``)."""
    r = F.col(row).cast("string")
    c = F.col(col).cast("string")
    clean = df.filter(is_answered(r, na) & is_answered(c, na)).select(r.alias(row), c.alias(col))
    table = clean.groupBy(row).pivot(col, list(values) if values is not None else None).count()
    counts = [x for x in table.columns if x != row]
    return table.fillna(0, subset=counts)


def contingency_lines(df: DataFrame, row: str, col: str, na: str = NA, sep: str = ",") -> tuple[str, DataFrame]:
    """The contingency table as text for a file: (header, lines (row, line)),
    with any number of categories of ``col``.

    Spark's pivot makes a column, an expression and a slot in every aggregate
    for each category and stops at ``spark.sql.pivotMaxValues``.  Here the
    first pass finds the categories (the header, in their sort order, is the
    only thing the driver holds); the second counts cells, sorts the cells
    of a row by their category's place and writes the zeros between two
    cells as one piece.  Rows with null/'NA' in either column are ignored.
    """
    r, c = F.col(row).cast("string"), F.col(col).cast("string")
    cells = (df.filter(is_answered(r, na) & is_answered(c, na)).groupBy(r.alias("row"), c.alias("cat"))
             .agg(F.count(F.lit(1)).alias("n")))
    cells = cut_lineage(cells)
    cats = [x.cat for x in cells.select("cat").distinct().orderBy("cat").collect()]
    places = small_frame(df.sparkSession, [(x, i) for i, x in enumerate(cats)], "cat string, place int")
    of_row = (cells.join(places, "cat").groupBy("row")
              .agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("cells")))
    zeros = lambda k: F.repeat(F.lit(f"{sep}0"), k)
    before = lambda i: F.when(i > 0, F.get("cells", i - 1)["place"]).otherwise(F.lit(-1))
    pieces = F.transform("cells", lambda x, i: F.concat(zeros(x["place"] - before(i) - 1), F.lit(sep), x["n"].cast("string")))
    rest = zeros(F.lit(len(cats) - 1) - F.element_at("cells", -1)["place"])
    cell = lambda text: F.when(F.rlike(text, F.lit(f'["\\n{sep}]')), F.concat(
        F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    quoted = ['"' + x.replace('"', '""') + '"' if any(ch in x for ch in ('"', "\n", sep)) else x for x in [row, *cats]]
    return sep.join(quoted), of_row.select("row", F.concat(cell(F.col("row")), F.array_join(pieces, ""), rest).alias("line"))


def association_matrix(df: DataFrame, cols: Sequence[str], key: str,
                       recode: Mapping[str, str] | None = MAYBE_AS_YES, na: str = NA) -> DataFrame:
    """Cramér's V for every ordered pair of ``cols`` (1.0 on the diagonal).

    One row per distinct (key, cols) is the unit.  The rows are first reduced
    to (value tuple, number of keys) - a handful of rows - and only then
    expanded into the k(k-1)/2 variable pairs, so the pair expansion never
    touches raw rows.  Each pair's V is mirrored to (var2, var1).
    """
    vals = [replace_values(F.col(c).cast("string"), recode or {}).alias(c) for c in cols]
    tuples = df.groupBy(*vals).agg(F.countDistinct(key).alias("o"))
    pair_structs = [F.struct(F.lit(a).alias("var1"), F.col(a).alias("v1"),
                             F.lit(b).alias("var2"), F.col(b).alias("v2"))
                    for i, a in enumerate(cols) for b in cols[i + 1:]]
    cells = (tuples.select("o", F.inline(F.array(*pair_structs)))
             .filter(is_answered("v1", na) & is_answered("v2", na))
             .groupBy("var1", "var2", "v1", "v2").agg(F.sum("o").alias("o")))
    upper = _v_from_cells(cells, ["var1", "var2"])
    lower = upper.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "n", "cramers_v")
    diag_structs = [F.struct(F.lit(c).alias("var1"), F.col(c).alias("v")) for c in cols]
    diag = (tuples.select("o", F.inline(F.array(*diag_structs)))
            .filter(is_answered("v", na))
            .groupBy("var1").agg(F.sum("o").cast("long").alias("n"))
            .select("var1", F.col("var1").alias("var2"), "n", F.lit(1.0).alias("cramers_v")))
    found = upper.unionByName(lower).unionByName(diag)
    # every ordered pair has a row: without answered rows V is 0, on the diagonal 1
    every = small_frame(df.sparkSession, [(a, b) for a in cols for b in cols], "var1 string, var2 string")
    empty = F.when(F.col("var1") == F.col("var2"), F.lit(1.0)).otherwise(F.lit(0.0))
    return every.join(found, ["var1", "var2"], "left").select(
        "var1", "var2", F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        F.when(F.col("n").isNull(), empty).otherwise(F.col("cramers_v")).alias("cramers_v"))


def histogram_equal_width(df: DataFrame, value: str | F.Column, bins: int = 10,
                          upper_limit: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``bins`` equal-width bins between the minimum and maximum, of all
    values or (``by``) of each group with its own bounds.

    A value v falls in bin clamp(ceil((v - min) / w), 1, bins): right edges
    closed, the minimum joins the first bin, min = max puts all in bin 1.
    Values above ``upper_limit`` are left out before the bounds are taken.
    Empty bins are listed, for every group that has a value; a null group is
    a group.  Columns: by..., bin, breakpoint (right edge), count, percentage,
    cum_count, cum_pct (percentages of the group).

    The bounds are one row per group, joined back to the values (broadcast
    where they are few); counts collapse in the tasks, so a group that holds
    most of the rows is ``bins`` rows from each.
    """
    by = list(by)
    v = (as_number(value) if isinstance(value, str) else value.cast("double")).alias("_v")
    vals = df.select(*by, v).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if upper_limit is not None:
        vals = vals.filter(F.col("_v") <= F.lit(float(upper_limit)))
    bounds = vals.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if by:
        rows = same_group(vals, bounds, by)
    else:  # one row of bounds: scalar subqueries, no join
        rows = vals.withColumns({c: bounds.select(c).scalar() for c in ("_lo", "_hi")})
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.greatest(F.ceil((F.col("_v") - F.col("_lo")) / width), F.lit(1)), F.lit(bins))).cast("int")
    counts = rows.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = bounds.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    out = same_group(spine, counts, [*by, "bin"], "left").withColumn("count", F.coalesce(F.col("count"), F.lit(0).cast("long")))
    total = F.sum("count").over(Window.partitionBy(*by))
    run = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.when(F.col("bin") == F.lit(bins), F.col("_hi")).otherwise(F.col("_lo") + F.col("bin") * width)
    return out.select(
        *by, "bin", edge.alias("breakpoint"), "count",
        percent(F.col("count"), total).alias("percentage"),
        F.sum("count").over(run).alias("cum_count"),
        percent(F.sum("count").over(run), total).alias("cum_pct"))


def histogram_fixed_width(df: DataFrame, value: str | F.Column, width: float = 500.0,
                          start: float = 0.0, end: float = 10000.0, by: Sequence[str] = ()) -> DataFrame:
    """Counts in bins [start + i*width, start + (i+1)*width) on [start, end),
    per ``by`` group.  Values outside the range are not counted."""
    v = (as_number(value) if isinstance(value, str) else value.cast("double"))
    rows = df.select(*by, v.alias("v")).filter(
        (F.col("v") >= F.lit(float(start))) & (F.col("v") < F.lit(float(end))))
    idx = F.floor((F.col("v") - F.lit(float(start))) / F.lit(float(width)))
    counts = rows.groupBy(*by, idx.alias("_i")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        *by,
        (F.lit(float(start)) + F.col("_i") * F.lit(float(width))).alias("bin_start"),
        (F.lit(float(start)) + (F.col("_i") + 1) * F.lit(float(width))).alias("bin_end"),
        "count")


def income_per_capita(long: DataFrame, panel: DataFrame, income_q: str, size_q: str,
                      keep: Sequence[str] = (), na: str = NA) -> DataFrame:
    """Answered income at FIRST/LAST divided by the household size.

    The size is taken from the long table (asked at one wave only, not
    necessarily a panel wave).  Families need both (inner join); a size of 0
    or a non-number gives a null per-capita value.
    """
    size = (long.filter((F.col(S.QUESTION) == F.lit(size_q)) & (F.col(S.ANSWER) != F.lit(na)))
            .select(S.FAMILY, as_number(F.col(S.ANSWER)).alias("household_size")))
    income = (panel.filter((F.col(S.QUESTION) == F.lit(income_q)) & (F.col(S.ANSWER) != F.lit(na)))
              .select(S.FAMILY, S.TIME, *keep, as_number(F.col(S.ANSWER)).alias("income")))
    return (income.join(size, S.FAMILY, "inner")
            .withColumn("per_capita", F.try_divide(F.col("income"), F.col("household_size"))))


def income_per_capita_of_rows(panel: DataFrame, income_q: str, size: str, keep: Sequence[str] = (),
                              na: str = NA) -> DataFrame:
    """B23 where the household size is a column of the panel rows (an id
    carried along from the export): the same result without a second scan or
    a join."""
    return (panel.filter((F.col(S.QUESTION) == F.lit(income_q)) & (F.col(S.ANSWER) != F.lit(na)) & is_answered(size, na))
            .select(S.FAMILY, S.TIME, *keep, as_number(F.col(S.ANSWER)).alias("income"),
                    as_number(F.col(f"`{size}`")).alias("household_size"))
            .withColumn("per_capita", F.try_divide(F.col("income"), F.col("household_size"))))


STATISTICS = ["count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def group_describe(df: DataFrame, value: str, by: Sequence[str] = (), materialize: bool = False,
                   interpolation: str = "linear") -> DataFrame:
    """Count, null_count, mean, std, min, quartiles, max of ``value`` per group.

    Long layout (by..., statistic, value), nine rows for every group, also
    for a null key and a group without values (its numbers are null but the
    counts).  NaN counts as null in all nine.  Quartiles are exact with linear
    interpolation (``quantiles.from_brackets``).  The input is read twice;
    with ``materialize`` (for an expensive derived input) it is written once
    to the shared checkpoint folder and read back.
    """
    vals = df.select(*by, number(F.col(value)).alias("_x"))
    if materialize:
        vals = cut_lineage(vals)
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"interpolation must be one of {INTERPOLATIONS}")
    probs, x = [0.25, 0.5, 0.75], F.col("_x")
    base = cut_lineage(vals.groupBy(*by).agg(
        F.count(x).cast("double").alias("count"),
        F.sum(F.when(x.isNull(), F.lit(1)).otherwise(F.lit(0))).cast("double").alias("null_count"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        *brackets(x, probs)))
    q = from_brackets(vals, narrowed(vals, base.select(*by, "_n", "_s"), by, probs), by, probs, interpolation)
    every = base.select(*by, F.explode(F.array(*[F.lit(p) for p in probs])).alias("p"))
    qlong = same_group(every, q, [*by, "p"], "left").select(
        *by, F.concat(F.format_number(F.col("p") * 100, 0), F.lit("%")).alias("statistic"), F.col("q").alias("value"))
    stats = ["count", "null_count", "mean", "std", "min", "max"]
    blong = base.select(*by, F.inline(F.array(*[
        F.struct(F.lit(s).alias("statistic"), F.col(f"`{s}`").alias("value")) for s in stats])))
    return blong.unionByName(qlong)
