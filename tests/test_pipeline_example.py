"""The README's real-export flow on a small hand-made export."""

import os
import uuid

from wavepanel.operators import build_column_map, frequency_table, missing_table
from wavepanel.plans import dictionaries as D
from wavepanel.plans import survey as SV
from wavepanel.plans.pipeline import SurveySpec, panel_from_export
from wavepanel.session import checkpoint_dir
from wavepanel.sources import load_wide, read_export_csv, read_long, write_export_csv, write_long

NEW = ["id_family_datalake", "FavelaID", "Categoria_IGF_T0", "CategoriaIGF_T2", "CategoriaIGF_T3",
       "M_ATI_Walls_T1", "M_ATI_Walls_T3", "CH_IB_Race_T0"]
OLD = ["id_family_datalake", "FavelaID", "Drogadicao", "Garbage_T1", "Garbage_T3"]


def test_export_to_tables(spark):
    base = os.path.join(checkpoint_dir(spark), f"example-{uuid.uuid4().hex}")
    new_rows = [("1", "Boca do Sapo (São Paulo)", "E1", "NA", "P1", "Alvenaria", "Madeira", "Parda"),
                ("2", "Vila", "E2", "D", None, "Madeira", "NA", "Amarela (Asiática)"),
                ("3", "Vila", "NA", "E1", "E2", "Alvenaria", "Alvenaria", "Não sabe")]
    old_rows = [("1", "stale", "talvez", "Rua;Caçamba", "NA;NA"), ("2", "stale", "nao", "NA", "Rua"),
                ("3", "stale", "sim", "Rua", "Rua")]
    write_export_csv(spark.createDataFrame(new_rows, ", ".join(f"`{c}` string" for c in NEW)),
                     os.path.join(base, "new"))
    write_export_csv(spark.createDataFrame(old_rows, ", ".join(f"`{c}` string" for c in OLD)),
                     os.path.join(base, "old"))
    wide = load_wide(read_export_csv(spark, os.path.join(base, "new")),
                     read_export_csv(spark, os.path.join(base, "old")), key="id_family_datalake")
    spec = SurveySpec(
        key="id_family_datalake", territory="FavelaID", anchor=SV.ANCHOR_QUESTION,
        column_map=build_column_map({"Categoria_IGF_T0": "CategoriaIGF_T0"},
                                    stems=["CategoriaIGF", "M_ATI_Walls", "Garbage"], waves=[1, 2, 3]),
        profile={"CH_IB_Race_T0": ("race", SV.RACE_CATEGORIES),
                 "Drogadicao": ("drug_addiction", SV.YES_NO_CATEGORIES)},
        ids=["race", "drug_addiction"], territory_renames=SV.TERRITORY_RENAMES)
    panel = panel_from_export(wide, spec)
    write_long(panel, os.path.join(base, "panel"))
    panel = read_long(spark, os.path.join(base, "panel"))

    # family 1: anchor at 0 and 3; family 2: 0..2; family 3: 2..3 (gap 1, dropped)
    fams = {(r.family, r.time_first, r.time_last) for r in panel.select("family", "time_first", "time_last").distinct().collect()}
    assert fams == {("1", 0, 3), ("2", 0, 2)}
    walls = {(r.family, r.time, r.answer) for r in panel.filter("question = 'Walls'").collect()}
    assert walls == {("1", "LAST", "Madeira")}  # Walls has no T0 column, family 2 has no T2 cell
    garbage = sorted((r.family, r.time, r.answer) for r in panel.filter("question = 'Garbage'").collect())
    assert garbage == [("1", "LAST", SV.NONE_LABEL)]
    prof = {r.family: (r.territory, r.race, r.drug_addiction) for r in panel.collect()}
    assert prof["1"] == ("Favela dos Sonhos (São Paulo)", "Parda", "Sim")
    assert prof["2"] == ("Vila", "Amarela", "Não")
    freq = {(r.question, r.time, r.answer): r.n for r in frequency_table(panel).collect()}
    assert freq[("CategoriaIGF", "FIRST", "E1")] == 1 and freq[("CategoriaIGF", "LAST", "D")] == 1
    miss = {r.question: (r.count_first, r.count_last) for r in
            missing_table(panel, D.questions_frame(spark, ["CategoriaIGF", "Walls", "Garbage"])).collect()}
    assert miss == {"CategoriaIGF": (0, 0), "Walls": (0, 0), "Garbage": (0, 0)}
