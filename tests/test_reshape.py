"""Ingest: column map, unpivot, profile lookup, normalisation, explode."""

from pyspark.sql import functions as F

from wavepanel.operators.reshape import (build_column_map, explode_assertions, logical_parts,
                                         map_profile, normalize_values, to_long)
from wavepanel.plans.survey import NONE_LABEL, YES_NO_CATEGORIES

# raw answer -> exploded rows
CASES = [
    ("NA", ["NA"]), ("a", ["a"]), ("a;b", ["a", "b"]), ("NA;NA", [NONE_LABEL]),
    ("NA;NA;NA", [NONE_LABEL]), ("a;NA;b", ["a", "b"]), ("NA;a", ["a"]), ("", [""]),
    ("a;;b", ["a", "", "b"]), ("NA;NA;", [""]), (" a; NA", [" a", " NA"]), ("a;NA;", ["a", ""]),
    (None, []),
]


def _long(spark, answers, question="Q"):
    rows = [(str(i), "t", 0, question, a) for i, a in enumerate(answers)]
    return spark.createDataFrame(rows, "family string, territory string, time int, question string, answer string")


def test_explode_edge_cases(spark):
    df = _long(spark, [raw for raw, _ in CASES])
    got = {}
    for r in explode_assertions(df).collect():
        got.setdefault(int(r.family), []).append(r.answer)
    for i, (raw, want) in enumerate(CASES):
        assert sorted(got.get(i, [])) == sorted(want), raw


def test_explode_matches_three_branch_union(spark):
    """One-pass explode equals the split / all-NA / NA union on random strings."""
    import random
    rnd = random.Random(7)
    parts = ["NA", "a", "b", "", " NA"]
    answers = [";".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    df = _long(spark, answers)
    one = sorted((r.family, r.answer) for r in explode_assertions(df).collect())
    split = (df.filter(F.col("answer") != "NA")
             .withColumn("answer", F.explode(F.split("answer", ";", -1)))
             .filter(F.col("answer") != "NA"))
    none = df.filter(F.col("answer").rlike(r"^(NA;)+NA\z")).withColumn("answer", F.lit(NONE_LABEL))
    na = df.filter(F.col("answer") == "NA")
    three = sorted((r.family, r.answer) for r in split.unionByName(none).unionByName(na).collect())
    assert one == three


def test_multi_questions_only_split_listed(spark):
    df = _long(spark, ["a;b"], "Single").unionByName(_long(spark, ["a;b"], "Multi"))
    rows = explode_assertions(df, multi_questions=["Multi"]).collect()
    assert sorted((r.question, r.answer) for r in rows) == [("Multi", "a"), ("Multi", "b"), ("Single", "a;b")]


def test_column_map_and_logical_parts():
    cmap = build_column_map({"X_DC_Walls_T0": "Walls_T0"}, stems=["M_ATI_Walls", "Garbage"], waves=[1, 2])
    by_orig = {c.original_column: c for c in cmap}
    assert by_orig["M_ATI_Walls_T1"].column == "Walls_T1"
    assert by_orig["M_ATI_Walls_T2"].question == "Walls" and by_orig["M_ATI_Walls_T2"].time == 2
    assert by_orig["Garbage_T1"].column == "Garbage_T1"
    assert by_orig["X_DC_Walls_T0"].time == 0
    assert logical_parts("A_B_T3") == ("B", 3)
    assert logical_parts("CategoriaIGF_T0") == ("CategoriaIGF", 0)
    assert logical_parts("NoWave") == (None, None)


def test_to_long_keeps_mapped_columns_and_nulls(spark):
    wide = spark.createDataFrame(
        [("1", "T", "x", None, "junk")],
        "key string, terr string, Q_T0 string, Q_T1 string, Noise_T0 string")
    cmap = build_column_map(stems=["Q"], waves=[0, 1, 2])  # Q_T2 absent from the export
    out = to_long(wide, cmap, "key", "terr").collect()
    assert sorted((r.time, r.answer) for r in out) == [(0, "x"), (1, None)]
    assert {r.question for r in out} == {"Q"}
    assert {r.column for r in out} == {"Q_T0", "Q_T1"}


def test_map_profile_unmapped_is_null(spark):
    wide = spark.createDataFrame([("1", "talvez"), ("2", "nao"), ("3", "?"), ("4", None)], "k string, f string")
    out = {r.k: r.f for r in map_profile(wide, {"f": ("f", YES_NO_CATEGORIES)}).collect()}
    assert out == {"1": "Sim", "2": "Não", "3": None, "4": None}


def test_normalize_values(spark):
    df = spark.createDataFrame([("1", "Boca", 0, "H", "a,b"), ("2", "X", 0, "Z", "a,b")],
                               "family string, territory string, time int, question string, answer string")
    out = {r.family: (r.territory, r.answer) for r in
           normalize_values(df, ["H"], {"Boca": "Sonhos"}).collect()}
    assert out == {"1": ("Sonhos", "a;b"), "2": ("X", "a,b")}
