"""The survey defined on the driver's order tables (see sources.tpch_panel).

Questions: Status (anchor, single answer), Priority (recoded 5 -> 3
classes), Income (money as text), Items (multi answer: statuses of large
orders), HowMany (asked at wave 0 only).  Profile flags a-d are yes/no/maybe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.reshape import build_column_map, map_profile
from ..sources import tpch_panel
from . import dictionaries as D
from .pipeline import SurveySpec, kept_families, long_table, panel_from_export, periods_from_export
from .survey import NA, NONE_LABEL, YES_NO_CATEGORIES

QUESTIONS = ["Status", "Priority", "Income", "Items", "HowMany"]
FLAGS = ["flag_a", "flag_b", "flag_c", "flag_d"]

COLUMN_MAP = build_column_map({"HowMany_T0": "HowMany_T0"},
                              stems=["Status", "Priority", "Income", "Items"], waves=tpch_panel.WAVES)

SPEC = SurveySpec(
    key=tpch_panel.KEY,
    territory=tpch_panel.TERRITORY,
    column_map=COLUMN_MAP,
    anchor="Status",
    ids=["region", "segment"] + FLAGS,
    profile={f: (f, YES_NO_CATEGORIES) for f in FLAGS},
    multi_questions=None,
    unique_key=True,
)

ANSWERS = {
    "Status": {"order": [NA, "F", "O", "P"]},
    "Priority": {"map": {"HIGH": ["1-URGENT", "2-HIGH"], "MEDIUM": ["3-MEDIUM"],
                         "LOW": ["4-NOT SPECIFIED", "5-LOW"]},
                 "order": [NA, "LOW", "MEDIUM", "HIGH"]},
    "Items": [{"order": [NA, NONE_LABEL, "F", "O", "P"]},
              {"map": {"Some": ["F", "O", "P"]}, "order": [NA, NONE_LABEL, "Some"]}],
}

LABELS = {
    "Status": "Status of the latest order",
    "Priority": "Priority of the latest order",
    "Income": "Total ordered in the period",
    "Items": "Statuses with a large order",
    "HowMany": "Orders in the first period",
}

POLARITY = {"positive": {"Items": ["F"]}, "negative": {"Items": ["O", "P"]}}

MULTI_QUESTIONS = ["Items"]


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tpch_panel.panel_export(spark, sf_dir)


def long(spark: SparkSession, sf_dir: str, questions: list[str] | None = None) -> DataFrame:
    return long_table(export(spark, sf_dir), SPEC, questions)


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_profile(kept_families(export(spark, sf_dir), SPEC), SPEC.profile)


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_from_export(export(spark, sf_dir), SPEC)


def panel(spark: SparkSession, sf_dir: str, questions: list[str] | None = None) -> DataFrame:
    return panel_from_export(export(spark, sf_dir), SPEC, questions)


def recode(spark: SparkSession) -> DataFrame:
    return D.recode_frame(spark, ANSWERS)


def order(spark: SparkSession) -> DataFrame:
    return D.order_frame(spark, ANSWERS)


def labels(spark: SparkSession) -> DataFrame:
    return D.labels_frame(spark, LABELS)


def questions(spark: SparkSession) -> DataFrame:
    return D.questions_frame(spark, QUESTIONS)


def assertions(spark: SparkSession) -> DataFrame:
    return D.assertions_frame(spark, POLARITY)
