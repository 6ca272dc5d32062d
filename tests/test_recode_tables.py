"""Recode/order (B8, B9, B24, B30, B31) and tables."""


from wavepanel.operators.recode import (answer_order, composite_flags, find_values, recode_answers,
                                        unrecoded_report)
from wavepanel.operators.tables import (assertion_counts, descriptive_table, frequency_table,
                                        missing_table)
from wavepanel.plans import dictionaries as D

PANEL = "family string, question string, time string, answer string, grp string"


def test_recode_is_simultaneous_and_keeps_unmapped(spark):
    rec = D.recode_frame(spark, {"Q": {"map": {"b": ["a"], "c": ["b"]}}})
    df = spark.createDataFrame([("1", "Q", "FIRST", v, "g") for v in ["a", "b", "x"]], PANEL)
    assert sorted(r.answer for r in recode_answers(df, rec).collect()) == ["b", "c", "x"]


def test_recode_variants(spark):
    rec = D.recode_frame(spark, {"Q": [{"order": ["a"]}, {"map": {"ab": ["a", "b"]}}]})
    df = spark.createDataFrame([("1", "Q", "FIRST", "a", "g"), ("1", "R", "FIRST", "a", "g")], PANEL)
    got = sorted((r.question, r.variant, r.answer) for r in recode_answers(df, rec, variant=None).collect())
    assert got == [("Q", 0, "a"), ("Q", 1, "ab"), ("R", 0, "a")]


def test_answer_order_and_filter(spark):
    order = D.order_frame(spark, {"Q": {"order": ["NA", "lo", "hi"]}})
    df = spark.createDataFrame([("1", "Q", "FIRST", a, "g") for a in ["lo", "hi", "odd", "NA"]]
                               + [("1", "CategoriaX", "FIRST", "E2", "g"), ("1", "Free", "FIRST", "text", "g"),
                                  ("1", "Free", "FIRST", "NA", "g")], PANEL)
    ranked = {(r.question, r.answer): r["rank"] for r in answer_order(df, order).collect()}
    assert ranked == {("Q", "lo"): 1, ("Q", "hi"): 2, ("Q", "odd"): None, ("Q", "NA"): 0,
                      ("CategoriaX", "E2"): 2, ("Free", "text"): None, ("Free", "NA"): 0}
    kept = {(r.question, r.answer) for r in answer_order(df, order, keep_unknown=False).collect()}
    assert ("Q", "odd") not in kept and ("Free", "text") in kept
    report = [(r.question, r.answer, r.n) for r in unrecoded_report(df, order).collect()]
    assert ("Q", "odd", 1) in report and all(q != "Free" for q, _, _ in report)


def test_composite_flags_truth_table(spark):
    df = spark.createDataFrame([("Sim", "Sim"), ("Sim", "Não"), ("NA", "Sim"), (None, "Não"), (None, "Sim")],
                               "a string, b string")
    got = [r.both for r in composite_flags(df, "both", "a", "b").collect()]
    assert got == ["Sim", "Não", "Não", "Não", None]


def test_find_values(spark):
    df = spark.createDataFrame([("ring",), ("a ring",), ("wing",), ("ring",)], "v string")
    assert sorted(r.value for r in find_values(df, "v", "ring").collect()) == ["a ring", "ring"]


def test_frequency_shares_sum_to_100(spark):
    rows = [(str(i), "Q", t, a, "g") for i, (t, a) in enumerate(
        [("FIRST", "x"), ("FIRST", "y"), ("FIRST", "NA"), ("LAST", "x"), ("LAST", "x"), ("LAST", "y")])]
    out = frequency_table(spark.createDataFrame(rows, PANEL)).collect()
    for t in ("FIRST", "LAST"):
        assert abs(sum(r.pct for r in out if r.time == t) - 100) < 1e-9
        assert abs(sum(r.pct_valid for r in out if r.time == t and r.included) - 100) < 1e-9
    na = [r for r in out if r.answer == "NA"][0]
    assert na.pct_valid is None and na.included is False


def test_missing_table_counts_na_only_at_last(spark):
    rows = [("1", "Q", "FIRST", "x", "g"), ("1", "Q", "LAST", "NA", "g"),
            ("2", "Q", "FIRST", "x", "g"), ("2", "Q", "LAST", "x", "g")]
    qs = D.questions_frame(spark, ["Q", "Absent"])
    got = {r.question: (r.count_first, r.pct_first, r.count_last, r.pct_last, r.over_threshold)
           for r in missing_table(spark.createDataFrame(rows, PANEL), qs).collect()}
    assert got == {"Q": (0, 0.0, 1, 50.0, False), "Absent": (0, 0.0, 0, 0.0, False)}


def test_descriptive_table(spark):
    rows = [("1", "Q", "FIRST", "a", "g1"), ("2", "Q", "FIRST", "b", "g1"), ("1", "Q", "LAST", "b", "g1"),
            ("3", "Q", "LAST", "a", "g2"), ("4", "Q", "FIRST", "NA", "g2")]
    out = {(r.answer, r.dim): r for r in descriptive_table(spark.createDataFrame(rows, PANEL), "Q", "grp").collect()}
    assert out[("a", "g1")].pct_first == 0.5 and out[("a", "g1")].count_last == 0
    assert out[("b", "g1")].delta_count == 0 and out[("a", "g2")].pct_last == 1.0


def test_assertion_counts_zero_filled(spark):
    ass = D.assertions_frame(spark, {"positive": {"Q": ["good"]}, "negative": {"Q": ["bad"]}})
    rows = [("1", "Q", "FIRST", "good", "g"), ("1", "Q", "FIRST", "bad", "g"), ("1", "Q", "FIRST", "bad", "g"),
            ("2", "Q", "LAST", "other", "g"), ("3", "R", "LAST", "good", "g")]
    got = sorted((r.family, r.time, r.polarity, r.n)
                 for r in assertion_counts(spark.createDataFrame(rows, PANEL), ass).collect())
    assert got == [("1", "FIRST", "negative", 2), ("1", "FIRST", "positive", 1),
                   ("2", "LAST", "negative", 0), ("2", "LAST", "positive", 0)]


def test_collapse_keeps_or_absorbs_missing(spark):
    from wavepanel.functions.answers import collapse
    from wavepanel.plans.survey import RACE_COLLAPSE, RACE_COLLAPSE_OTHER

    df = spark.createDataFrame([("Parda",), ("Branca",), ("NA",), (None,)], "race string")
    kept = [r.g for r in df.select(collapse("race", RACE_COLLAPSE, RACE_COLLAPSE_OTHER).alias("g")).collect()]
    assert kept == ["Negros e indígenas", "Brancos e amarelos", "NA", None]
    compat = [r.g for r in df.select(collapse("race", RACE_COLLAPSE, RACE_COLLAPSE_OTHER,
                                              keep_missing=False).alias("g")).collect()]
    assert compat == ["Negros e indígenas"] + ["Brancos e amarelos"] * 3


def test_in_category_order(spark):
    from wavepanel.operators.recode import in_category_order

    order = D.order_frame(spark, {"Q": {"order": ["NA", "lo", "mid", "hi"]}})
    df = spark.createDataFrame([("1", "Q", "FIRST", a, "g") for a in ["hi", "zz", "lo", "NA", "mid", "aa"]], PANEL)
    assert [r.answer for r in in_category_order(df, order).collect()] == ["NA", "lo", "mid", "hi", "aa", "zz"]


def test_contingency_table(spark):
    from wavepanel.operators.stats import contingency_table

    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("NA", "x"), (None, "y")], "r string, c string")
    got = {r.r: (r.x, r.y) for r in contingency_table(df, "r", "c").collect()}
    assert got == {"a": (1, 1), "b": (1, 0)}


def test_transition_matrix_shows_conflicts(spark):
    from wavepanel.operators.transitions import transition_matrix, transition_pairs

    panel = spark.createDataFrame(
        [("1", "Q", "FIRST", "a"), ("1", "Q", "FIRST", "b"), ("1", "Q", "LAST", "c"), ("2", "Q", "FIRST", "a"),
         ("2", "Q", "LAST", "c"), ("3", "Q", "FIRST", "a")],
        "family string, question string, time string, answer string")
    got = {(r.first_answer, r.last_answer): (r.n, r.n_conflicts) for r in transition_matrix(transition_pairs(panel)).collect()}
    assert got == {("a", "c"): (2, 1), ("a", None): (1, 0)}
