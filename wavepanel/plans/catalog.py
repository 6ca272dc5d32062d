"""The registered queries: one per operator, each (spark, sf_dir) -> DataFrame.

Panel queries run on the survey derived from the order tables
(``plans.fixture``); the statistics also run directly on raw tables
(lineitem, orders, events, documents x labels, part) so their work grows
with the data.  Doubles are rounded to 6 places for the oracle comparison.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .. import schema as S
from ..operators import incremental
from ..operators import panel as P
from ..operators import recode as R
from ..operators import reshape as X
from ..operators import stats as ST
from ..operators import tables as T
from ..operators import transitions as TR
from ..session import checkpoint_dir
from ..sources import customer_files, exports, readers, tpch_panel
from . import fixture as fx
from .lineage import cut_lineage, delete_at_exit
from .pipeline import _cells, long_table, panel_from_export, panel_from_long, periods_from_long


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def q_load_wide_join(spark: SparkSession, sf: str) -> DataFrame:
    new, old = tpch_panel.export_halves(spark, sf)
    return readers.load_wide(new, old, tpch_panel.KEY)


def _new_export(spark, sf):
    return exports.read_exports(spark, os.path.join(customer_files.write_exports(spark, sf), "new"), mode="PERMISSIVE")


def q_load_wide_files(spark, sf):
    """Two exports as CSV files, their headers reconciled, malformed records
    split off, duplicate families reported, merged."""
    path = customer_files.write_exports(spark, sf)
    new = exports.read_exports(spark, os.path.join(path, "new"), mode="PERMISSIVE")
    old = exports.read_exports(spark, os.path.join(path, "old"))
    return exports.load_wide(new.rows, old.rows, customer_files.KEY, on_duplicates="report")


def q_bad_records(spark, sf):
    return _new_export(spark, sf).bad.select("record")


def q_export_key_report(spark, sf):
    return exports.key_report(_new_export(spark, sf).rows, customer_files.KEY)


def q_to_long(spark, sf):
    return _cells(fx.export(spark, sf), fx.SPEC)


def q_profile_map(spark, sf):
    return X.map_profile(fx.export(spark, sf), fx.SPEC.profile).select(tpch_panel.KEY, *fx.FLAGS)


def q_normalize_values(spark, sf):
    cells = _cells(fx.export(spark, sf), fx.SPEC)
    out = X.normalize_values(cells, sep_questions=["Items"], territory_renames={"NATION_1": "NATION_ONE"},
                             from_sep=";", to_sep="|")
    return out.select(S.FAMILY, S.TERRITORY, S.TIME, S.QUESTION, S.ANSWER)


def q_explode_assertions(spark, sf):
    return fx.long(spark, sf)


def q_comma_answers(spark, sf):
    """An export whose item lists are separated by commas, to the same long table."""
    wide = fx.export(spark, sf).withColumns({c: F.replace(F.col(c), F.lit(";"), F.lit(","))
                                             for c in (f"Items_T{w}" for w in tpch_panel.WAVES)})
    return long_table(wide, replace(fx.SPEC, sep_questions=["Items"]))


def q_long_parquet_roundtrip(spark, sf):
    path = os.path.join(checkpoint_dir(spark), f"long-{uuid.uuid4().hex}")
    readers.write_long(fx.long(spark, sf), path)
    return readers.read_long(spark, path)


def q_recode_answers(spark, sf):
    out = R.recode_answers(fx.long(spark, sf), fx.recode(spark), variant=None)
    return out.select(S.FAMILY, S.TIME, S.QUESTION, R.VARIANT, S.ANSWER)


def q_ordered_answers(spark, sf):
    rec = R.recode_answers(fx.panel(spark, sf), fx.recode(spark), variant=0)
    out = R.answer_order(rec, fx.order(spark))
    return out.select(S.FAMILY, S.TIME, S.QUESTION, S.ANSWER, R.RANK)


def q_first_last_wave(spark, sf):
    return periods_from_long(fx.long(spark, sf), fx.SPEC)


def q_first_last_wave_colocated(spark, sf):
    """The long table stored in buckets of the family; no shuffle after that."""
    path = os.path.join(checkpoint_dir(spark), f"long-buckets-{uuid.uuid4().hex}")
    delete_at_exit(spark, path)
    long = readers.write_bucketed(fx.long(spark, sf), f"long_{uuid.uuid4().hex}", S.FAMILY, 8, path)
    return P.first_last_wave(long, fx.SPEC.anchor, colocated=True)


def q_incremental_panel(spark, sf):
    """The panel after four loads, a wave each, the last one delivered twice."""
    path = os.path.join(checkpoint_dir(spark), f"panel-{uuid.uuid4().hex}")
    delete_at_exit(spark, path)
    long = cut_lineage(fx.long(spark, sf))
    store = incremental.PanelStore(spark, path, fx.SPEC.anchor)
    for wave in (*tpch_panel.WAVES, tpch_panel.WAVES[-1]):
        store.load(f"wave-{wave}", long.filter(F.col(S.TIME) == wave))
    return store.panel()


def q_periods_from_export(spark, sf):
    return fx.periods(spark, sf)


def q_panel_rows(spark, sf):
    return fx.panel(spark, sf)


def q_panel_from_long(spark, sf):
    return panel_from_long(fx.long(spark, sf), fx.SPEC)


def q_period_distribution(spark, sf):
    return finish(P.period_distribution(fx.periods(spark, sf)))


def q_respondents_by_territory(spark, sf):
    return P.respondents_by_territory(fx.panel(spark, sf))


def q_frequency_all_questions(spark, sf):
    return finish(T.frequency_table(fx.panel(spark, sf), recode=fx.recode(spark),
                                    multi_questions=fx.MULTI_QUESTIONS))


def q_frequency_by_territory(spark, sf):
    return finish(T.frequency_table(fx.panel(spark, sf), by=[S.TERRITORY], recode=fx.recode(spark),
                                    multi_questions=fx.MULTI_QUESTIONS))


def q_frequency_item_variants(spark, sf):
    return finish(T.frequency_table(fx.panel(spark, sf, ["Items"]), questions=["Items"], recode=fx.recode(spark),
                                    order=fx.order(spark), variant=None, filter_by_order=True,
                                    multi_questions=fx.MULTI_QUESTIONS))


def q_frequency_family_share(spark, sf):
    return finish(T.frequency_table(fx.panel(spark, sf, ["Items"]), questions=["Items"], recode=fx.recode(spark),
                                    multi_questions=fx.MULTI_QUESTIONS, family_share=True))


def lineitem_flags(spark, sf):
    li = readers.table(spark, sf, "lineitem")
    return li.select(
        F.year("l_shipdate").alias(S.TIME),
        F.inline(F.array(
            F.struct(F.lit("returnflag").alias(S.QUESTION), F.col("l_returnflag").alias(S.ANSWER)),
            F.struct(F.lit("linestatus").alias(S.QUESTION), F.col("l_linestatus").alias(S.ANSWER)))))


def q_frequency_lineitem_flags(spark, sf):
    return finish(T.frequency_table(lineitem_flags(spark, sf)))


def q_missing_table(spark, sf):
    return finish(T.missing_table(fx.panel(spark, sf), fx.questions(spark), fx.labels(spark)))


def q_transition_matrix(spark, sf):
    pairs = TR.transition_pairs(fx.panel(spark, sf, ["Status"]), ["Status"], order=fx.order(spark))
    return finish(TR.transition_matrix(pairs))


def q_transition_flows(spark, sf):
    return finish(TR.transition_flows(fx.panel(spark, sf, ["Items"]), ["Items"], order=fx.order(spark)))


def q_transitions_excluding(spark, sf):
    """Collapsed with the missing values in 'other', and one group left out."""
    return finish(TR.grouped_transitions(
        fx.panel(spark, sf, ["Priority"]), "Priority", "flag_a", recode=fx.recode(spark), order=fx.order(spark),
        groups={"yes": ["Sim"], "no": ["Não"]}, other="open", exclude=["no"], keep_missing=False))


def q_transitions_by_group(spark, sf):
    return finish(TR.grouped_transitions(
        fx.panel(spark, sf, ["Priority"]), "Priority", "segment", recode=fx.recode(spark), order=fx.order(spark),
        groups={"HOME": ["HOUSEHOLD", "BUILDING", "FURNITURE"]}, other="INDUSTRY"))


def q_paired_scores(spark, sf):
    return finish(TR.paired_scores(fx.panel(spark, sf, ["Income"]), "Income"))


def q_paired_scores_summary(spark, sf):
    return finish(TR.paired_scores_summary(TR.paired_scores(fx.panel(spark, sf, ["Income"]), "Income")))


def q_paired_scores_conflicts(spark, sf):
    """Order values of a customer's 1995 and 1998: several answers at a wave."""
    year = F.year("o_orderdate")
    orders = readers.table(spark, sf, "orders").filter(year.isin(1995, 1998)).select(
        F.col("o_custkey").alias(S.FAMILY), F.lit("value").alias(S.QUESTION),
        F.when(year == 1995, S.FIRST).otherwise(S.LAST).alias(S.TIME),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias(S.ANSWER))
    return finish(TR.paired_scores(orders, "value"))


def q_cramers_v_pair(spark, sf):
    return finish(ST.cramers_v(readers.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


def q_contingency_table(spark, sf):
    return ST.contingency_table(readers.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


def documents_labels(spark, sf):
    docs = readers.table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = readers.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "inner")


def q_association_matrix(spark, sf):
    return finish(ST.association_matrix(documents_labels(spark, sf),
                                        ["lang", "source", "quality", "toxic"], "doc_id"))


def q_hist_equal_width(spark, sf):
    return finish(ST.histogram_equal_width(readers.table(spark, sf, "orders"), F.col("o_totalprice"), bins=10))


def q_hist_fixed_width(spark, sf):
    return finish(ST.histogram_fixed_width(readers.table(spark, sf, "events"), F.col("value"),
                                           width=50, start=0, end=500, by=["event_type"]))


def q_hist_fixed_width_orders(spark, sf):
    return finish(ST.histogram_fixed_width(readers.table(spark, sf, "orders"), F.col("o_totalprice"),
                                           width=50000, start=0, end=500000))


def q_hist_income_by_wave_flag(spark, sf):
    return finish(ST.histogram_equal_width(fx.panel(spark, sf, ["Income"]), S.ANSWER, bins=8, upper_limit=900000.0,
                                           by=[S.TIME, "flag_a"]))


def q_hist_income_fixed_by_wave(spark, sf):
    return finish(ST.histogram_fixed_width(fx.panel(spark, sf, ["Income"]), S.ANSWER, width=100000, start=0, end=1000000,
                                           by=[S.TIME, "flag_a"]))


def per_capita(spark, sf):
    """The size stands in the same export row as the incomes: no join."""
    spec = replace(fx.SPEC, ids=[*fx.SPEC.ids, "HowMany_T0"])
    panel = panel_from_export(fx.export(spark, sf), spec, ["Income"])
    return ST.income_per_capita_of_rows(panel, "Income", "HowMany_T0", keep=fx.FLAGS)


def q_income_per_capita_from_long(spark, sf):
    return finish(ST.income_per_capita(fx.long(spark, sf, ["HowMany"]), fx.panel(spark, sf, ["Income"]), "Income", "HowMany",
                                       keep=fx.FLAGS))


def q_income_per_capita(spark, sf):
    return finish(per_capita(spark, sf))


def q_composite_flags(spark, sf):
    prof = X.map_profile(fx.export(spark, sf), fx.SPEC.profile).select(tpch_panel.KEY, "flag_a", "flag_b")
    return R.composite_flags(prof, "both_ab", "flag_a", "flag_b")


def q_group_describe(spark, sf):
    return finish(ST.group_describe(readers.table(spark, sf, "orders"), "o_totalprice", by=["o_orderpriority"]))


def q_income_describe(spark, sf):
    df = R.composite_flags(per_capita(spark, sf), "both_ab", "flag_a", "flag_b")
    return finish(ST.group_describe(df, "per_capita", by=[S.TIME, "both_ab"], materialize=True))


def q_frequency_by_flag(spark, sf):
    return finish(T.frequency_by_flag(fx.panel(spark, sf, ["Priority"]), "Priority", fx.FLAGS, pairs=[("flag_a", "flag_b")],
                                      recode=fx.recode(spark), multi_questions=fx.MULTI_QUESTIONS))


def q_descriptive_table(spark, sf):
    return finish(T.descriptive_table(fx.panel(spark, sf, ["Priority"]), "Priority", "segment", recode=fx.recode(spark)))


def q_one_answer_per_family(spark, sf):
    rows, _ = P.one_answer_per_family(fx.panel(spark, sf, ["Items"]))
    return rows


def q_answer_conflicts(spark, sf):
    _, conflicts = P.one_answer_per_family(fx.panel(spark, sf, ["Items"]))
    return conflicts


def q_assertion_counts(spark, sf):
    return T.assertion_counts(fx.panel(spark, sf, ["Items"]), fx.assertions(spark))


def q_find_values(spark, sf):
    return R.find_values(readers.table(spark, sf, "part"), "p_name", "ring")


def q_find_columns(spark, sf):
    """Only the columns whose names hold the term are read and unpivoted."""
    named = replace(fx.SPEC, column_map=[c for c in fx.SPEC.column_map if "_T0" in c.original_column])
    return R.find_values(long_table(fx.export(spark, sf), named), S.ORIGINAL_COLUMN, "_T0")


def q_frequency_in_category_order(spark, sf):
    """Counts with each answer's rank in its question's declared order."""
    table = T.frequency_table(fx.panel(spark, sf, ["Priority", "Status"]), recode=fx.recode(spark),
                              multi_questions=fx.MULTI_QUESTIONS)
    return R.answer_order(table, fx.order(spark)).select(S.QUESTION, S.TIME, S.ANSWER, R.RANK, "n")


def q_unrecoded_report(spark, sf):
    return R.unrecoded_report(fx.long(spark, sf), fx.order(spark), recode=None)


def q_csv_export_roundtrip(spark, sf):
    """The export written and read back as CSV (explicit all-string schema), then unpivoted."""
    wide = fx.export(spark, sf)
    path = os.path.join(checkpoint_dir(spark), f"export-csv-{uuid.uuid4().hex}")
    readers.write_export_csv(wide, path)
    back = readers.read_export_csv(spark, path)
    return _cells(back, fx.SPEC)


def q_respondents_by_territory_wave(spark, sf):
    return P.respondents_by_territory(fx.panel(spark, sf), by=[S.TERRITORY, S.TIME])


def q_frequency_compare_by(spark, sf):
    return finish(T.frequency_table(fx.panel(spark, sf, ["Priority"]), questions=["Priority"], compare_by="segment",
                                    recode=fx.recode(spark), multi_questions=fx.MULTI_QUESTIONS))


def q_association_flags(spark, sf):
    return finish(ST.association_matrix(fx.families(spark, sf), fx.FLAGS, tpch_panel.KEY))


def q_duplicate_keys(spark, sf):
    return exports.duplicate_keys(customer_files.new_rows(spark, sf), customer_files.KEY)


def q_profile_conflicts(spark, sf):
    """Over all long rows of an export whose families may occur twice, segment and flags."""
    rows = long_table(customer_files.seen_twice(fx.export(spark, sf)), fx.SPEC)
    return (P.profile_conflicts(rows, S.FAMILY, ["segment", *fx.FLAGS])
            .withColumnRenamed(S.FAMILY, customer_files.KEY))


QUERIES = {
    "load_wide_join": q_load_wide_join,
    "load_wide_files": q_load_wide_files,
    "bad_records": q_bad_records,
    "export_key_report": q_export_key_report,
    "duplicate_keys": q_duplicate_keys,
    "to_long": q_to_long,
    "profile_map": q_profile_map,
    "normalize_values": q_normalize_values,
    "explode_assertions": q_explode_assertions,
    "comma_answers": q_comma_answers,
    "long_parquet_roundtrip": q_long_parquet_roundtrip,
    "csv_export_roundtrip": q_csv_export_roundtrip,
    "recode_answers": q_recode_answers,
    "ordered_answers": q_ordered_answers,
    "first_last_wave": q_first_last_wave,
    "first_last_wave_colocated": q_first_last_wave_colocated,
    "incremental_panel": q_incremental_panel,
    "periods_from_export": q_periods_from_export,
    "panel_rows": q_panel_rows,
    "panel_from_long": q_panel_from_long,
    "period_distribution": q_period_distribution,
    "respondents_by_territory": q_respondents_by_territory,
    "respondents_by_territory_wave": q_respondents_by_territory_wave,
    "frequency_all_questions": q_frequency_all_questions,
    "frequency_by_territory": q_frequency_by_territory,
    "frequency_compare_by": q_frequency_compare_by,
    "frequency_item_variants": q_frequency_item_variants,
    "frequency_family_share": q_frequency_family_share,
    "frequency_lineitem_flags": q_frequency_lineitem_flags,
    "missing_table": q_missing_table,
    "transition_matrix": q_transition_matrix,
    "transition_flows": q_transition_flows,
    "transitions_excluding": q_transitions_excluding,
    "transitions_by_group": q_transitions_by_group,
    "paired_scores": q_paired_scores,
    "paired_scores_summary": q_paired_scores_summary,
    "paired_scores_conflicts": q_paired_scores_conflicts,
    "cramers_v_pair": q_cramers_v_pair,
    "contingency_table": q_contingency_table,
    "association_matrix": q_association_matrix,
    "association_flags": q_association_flags,
    "profile_conflicts": q_profile_conflicts,
    "hist_equal_width": q_hist_equal_width,
    "hist_fixed_width": q_hist_fixed_width,
    "hist_fixed_width_orders": q_hist_fixed_width_orders,
    "hist_income_by_wave_flag": q_hist_income_by_wave_flag,
    "hist_income_fixed_by_wave": q_hist_income_fixed_by_wave,
    "income_per_capita_from_long": q_income_per_capita_from_long,
    "income_per_capita": q_income_per_capita,
    "composite_flags": q_composite_flags,
    "group_describe": q_group_describe,
    "income_describe": q_income_describe,
    "frequency_by_flag": q_frequency_by_flag,
    "descriptive_table": q_descriptive_table,
    "one_answer_per_family": q_one_answer_per_family,
    "answer_conflicts": q_answer_conflicts,
    "assertion_counts": q_assertion_counts,
    "find_values": q_find_values,
    "find_columns": q_find_columns,
    "frequency_in_category_order": q_frequency_in_category_order,
    "unrecoded_report": q_unrecoded_report,
}

DESCRIPTIONS = {
    "load_wide_join": "B1 merge a new and an old export of the same families (new wins on shared columns)",
    "load_wide_files": "S1/B1 two CSV exports: headers reconciled, bad records split off, duplicate keys reported, merged",
    "bad_records": "S1 malformed records of the CSV export",
    "export_key_report": "T26 rows, keys, duplicate and conflicting keys of the CSV export",
    "duplicate_keys": "T26 data check: family keys occurring more than once in the export",
    "to_long": "B2/B3 unpivot the mapped question columns into one row per (family, cell)",
    "profile_map": "B4 normalise the yes/no/maybe profile flags by dictionary lookup",
    "normalize_values": "B5 separator replacement for listed questions and territory renames",
    "explode_assertions": "B6 the tidy long table: one row per ticked assertion",
    "comma_answers": "B5/B6 comma-separated answers normalised and exploded",
    "long_parquet_roundtrip": "B7 long table written partitioned by question and read back",
    "csv_export_roundtrip": "S1/S2 export written and read back as CSV, then unpivoted",
    "recode_answers": "B8 many-to-one recode of answers, every variant of every question",
    "ordered_answers": "B9 ordinal rank of each answer within its question's declared order",
    "first_last_wave": "B10 first/last answered anchor wave per family, from the long table",
    "first_last_wave_colocated": "B7/B10 the same from a long table in buckets of the family, without a shuffle",
    "incremental_panel": "B10/B11 the panel kept up to date over four wave loads",
    "periods_from_export": "B10 same, computed on the export rows without a shuffle",
    "panel_rows": "B11 rows at each family's first and last wave, tagged FIRST/LAST",
    "panel_from_long": "B11 the panel derived from the long table",
    "period_distribution": "B12 families per (first wave, last wave) and their share",
    "respondents_by_territory": "B13 distinct families per territory",
    "respondents_by_territory_wave": "B13 distinct families per territory and FIRST/LAST",
    "frequency_all_questions": "B14 answer counts and shares for every question at FIRST and LAST",
    "frequency_by_territory": "B14 same, split by territory (shares of the whole wave)",
    "frequency_compare_by": "B14 one question compared across customer segments",
    "frequency_item_variants": "B14 both recode variants of a multi-answer question, filtered by order",
    "frequency_family_share": "B14/T14 assertion counts with the share of families per answer",
    "frequency_lineitem_flags": "B14 on raw lineitem: return flag and line status per ship year",
    "missing_table": "B15 count and share of 'NA' per question at FIRST and LAST",
    "transition_matrix": "B16 first -> last answer flows with row shares",
    "transition_flows": "B16/J6 every FIRST answer to every LAST answer of multi-answer questions",
    "transitions_excluding": "B17 flows with missing values collapsed and a group left out",
    "transitions_by_group": "B17 recoded first -> last flows split by a collapsed segment",
    "paired_scores": "B18 numeric first and last value per family",
    "paired_scores_summary": "B18 n, means at FIRST/LAST, mean change, non-numeric pairs",
    "paired_scores_conflicts": "B18 first and last order value per customer, with the number of answers",
    "cramers_v_pair": "B19 Cramér's V of two lineitem flags",
    "contingency_table": "R2 contingency table of two lineitem flags (pivot, for export)",
    "association_matrix": "B20 Cramér's V for every pair of document attributes and labels",
    "association_flags": "B20 Cramér's V matrix of the families' profile flags",
    "profile_conflicts": "T25 data check: families with more than one profile",
    "hist_equal_width": "B21 equal-width histogram of order totals with cumulative shares",
    "hist_fixed_width": "B22 fixed-width histogram of event values per event type",
    "hist_fixed_width_orders": "B22 fixed-width histogram of order totals",
    "hist_income_by_wave_flag": "B21 equal-width income histogram per wave and flag, below a limit",
    "hist_income_fixed_by_wave": "B22 fixed-width income histogram per wave and flag",
    "income_per_capita_from_long": "B23 the same, size joined from the long table",
    "income_per_capita": "B23 answered totals at FIRST/LAST divided by the wave-0 order count",
    "composite_flags": "B24 'both yes' flag from two profile flags",
    "group_describe": "B25 count, mean, std, min, exact quartiles, max of order totals by priority",
    "income_describe": "B25 the same statistics of per-capita values by wave and composite flag",
    "frequency_by_flag": "B26 one question's frequencies within each flag level and flag pair",
    "descriptive_table": "B27 counts, group totals, shares and deltas by segment",
    "one_answer_per_family": "B28 one deterministic answer per (family, question, wave)",
    "answer_conflicts": "B28 (family, question, wave) groups with several answers",
    "assertion_counts": "B29 ticked positive/negative assertions per family and wave",
    "find_values": "B30 distinct part names containing a term",
    "find_columns": "B30 distinct export columns containing a term",
    "frequency_in_category_order": "B9/O2 counts with the answers' declared ranks",
    "unrecoded_report": "B31 answers outside their question's declared order, with counts",
}
