"""First/last wave and the FIRST/LAST panel."""

import random

from pyspark.sql import functions as F

from wavepanel.operators.panel import (family_waves, one_answer_per_family, panel_first_last,
                                       period_distribution, waves_from_wide)
from wavepanel.operators.reshape import build_column_map, explode_assertions, to_long

# anchor answered at these waves -> kept (first, last) or dropped
WAVE_CASES = {"a": ({0, 3}, (0, 3)), "b": ({0, 2}, (0, 2)), "c": ({1, 3}, (1, 3)), "d": ({0, 1}, None),
              "e": ({2}, None), "f": (set(), None), "g": ({0, 1, 3}, (0, 3))}


def _wide(spark, cases):
    rows = []
    for fam, (waves, _) in cases.items():
        rows.append((fam, "T", *[("E1" if w in waves else "NA") for w in range(4)]))
    return spark.createDataFrame(rows, "k string, terr string, A_T0 string, A_T1 string, A_T2 string, A_T3 string")


def test_first_last_wave_cases(spark):
    cmap = build_column_map(stems=["A"], waves=range(4))
    wide = _wide(spark, WAVE_CASES)
    long = explode_assertions(to_long(wide, cmap, "k", "terr"))
    got = {r.family: (r.time_first, r.time_last) for r in family_waves(long, "A").collect()}
    want = {f: exp for f, (_, exp) in WAVE_CASES.items() if exp}
    assert got == want
    fast = {r.k: (r.time_first, r.time_last) for r in waves_from_wide(wide, cmap, "A").collect()}
    assert fast == want


def test_wide_and_long_paths_agree_on_random_data(spark):
    rnd = random.Random(3)
    vals = ["E1", "NA", None, "NA;NA", "x;NA", ""]
    rows = [(str(i), "T", *[rnd.choice(vals) for _ in range(4)]) for i in range(400)]
    wide = spark.createDataFrame(rows, "k string, terr string, A_T0 string, A_T1 string, A_T2 string, A_T3 string")
    cmap = build_column_map(stems=["A"], waves=range(4))
    for gap in (0, 1, 2):
        long = explode_assertions(to_long(wide, cmap, "k", "terr"))
        slow = sorted(tuple(r) for r in family_waves(long, "A", min_gap=gap).collect())
        fast = sorted((r.k, r.time_first, r.time_last)
                      for r in waves_from_wide(wide, cmap, "A", min_gap=gap).collect())
        assert slow == fast


def test_panel_tags_and_at_most_two_waves(spark):
    df = spark.createDataFrame(
        [("1", 0, 0, 3, "Q", "a"), ("1", 1, 0, 3, "Q", "b"), ("1", 3, 0, 3, "Q", "c"), ("2", 2, 2, 2, "Q", "z")],
        "family string, time int, time_first int, time_last int, question string, answer string")
    rows = sorted((r.family, r.time, r.wave, r.answer) for r in panel_first_last(df).collect())
    assert rows == [("1", "FIRST", 0, "a"), ("1", "LAST", 3, "c"), ("2", "FIRST", 2, "z"), ("2", "LAST", 2, "z")]


def test_period_distribution_shares(spark):
    df = spark.createDataFrame([("1", 0, 3), ("1", 0, 3), ("2", 0, 3), ("3", 0, 2)],
                               "family string, time_first int, time_last int")
    got = {(r.time_first, r.time_last): (r["count"], r.percentage) for r in period_distribution(df).collect()}
    assert got == {(0, 3): (2, 66.67), (0, 2): (1, 33.33)}


def test_one_answer_per_family_conflicts(spark):
    df = spark.createDataFrame([("1", "Q", "FIRST", "b"), ("1", "Q", "FIRST", "a"), ("2", "Q", "FIRST", "c")],
                               "family string, question string, time string, answer string")
    rows, conflicts = one_answer_per_family(df)
    assert sorted((r.family, r.answer, r.n_answers) for r in rows.collect()) == [("1", "a", 2), ("2", "c", 1)]
    assert [r.family for r in conflicts.collect()] == ["1"]


def test_profile_conflicts_and_duplicate_keys(spark):
    from wavepanel.operators.panel import profile_conflicts
    from wavepanel.sources.readers import duplicate_keys

    df = spark.createDataFrame([("1", "Sim", "x"), ("1", "Sim", "y"), ("1", "Não", "z"), ("2", "Sim", "x")],
                               "family string, flag string, other string")
    assert [(r.family, r.n_profiles) for r in profile_conflicts(df, "family", ["flag"]).collect()] == [("1", 2)]
    assert [(r.family, r["count"]) for r in duplicate_keys(df, "family").collect()] == [("1", 3)]


def test_export_and_long_paths_agree_on_several_rows_per_family(spark):
    """A family in two export rows, and a row without a key."""
    from wavepanel.plans.pipeline import SurveySpec, long_table, panel_from_export, panel_from_long

    wide = spark.createDataFrame(
        [("1", "T", "a", "NA", "NA", "NA"), ("1", "T", "NA", "NA", "NA", "b"), ("2", "T", "a", None, "c", "NA"),
         ("3", "T", "a", "b", "NA", "NA"), (None, "T", "a", "NA", "NA", "b")],
        "k string, terr string, A_T0 string, A_T1 string, A_T2 string, A_T3 string")
    spec = SurveySpec(key="k", territory="terr", column_map=build_column_map(stems=["A"], waves=range(4)), anchor="A")
    fast = panel_from_export(wide, spec)
    slow = panel_from_long(long_table(wide, spec), spec)
    rows = lambda df: sorted((r.family, r.time, r.answer, r.time_first, r.time_last) for r in df.collect())
    assert rows(fast) == rows(slow)
    assert {r.family for r in fast.collect()} == {"1", "2"}


def test_profile_conflicts_query_compares_every_profile_column(spark, tmp_path):
    """Families whose rows differ in a flag only, or in the segment only, over the long rows of the order tables."""
    from wavepanel.plans.catalog import QUERIES

    base = str(tmp_path)
    sf = "/root/testdata/sf0.001"
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{base}/{name}.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").limit(0).write.parquet(f"{base}/orders.parquet")
    like = spark.read.parquet(f"{sf}/customer.parquet")
    rows = [(1, "A", 5.0), (1, "A", -5.0), (2, "A", 5.0), (2, "B", 5.0), (3, "A", 5.0), (3, "A", 5.0), (4, None, 5.0), (4, "A", -5.0),
            (4, "A", 5.0), (37, "A", 5.0), (74, "A", 5.0)]
    made = spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double")
    made.select(*[made[c].cast(like.schema[c].dataType) if c in made.columns else
                  (F.lit(0) if c == "c_nationkey" else F.lit(None)).cast(like.schema[c].dataType).alias(c)
                  for c in like.columns]).write.parquet(f"{base}/customer.parquet")
    got = {(r.id_family, r.n_profiles) for r in QUERIES["profile_conflicts"](spark, base).collect()}
    assert got == {("1", 2), ("2", 2), ("4", 3), ("74", 2)}
