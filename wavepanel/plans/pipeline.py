"""Composed jobs: export -> long table -> periods -> FIRST/LAST panel.

``SurveySpec`` carries what differs between surveys (names, column map,
profile dictionaries, anchor question).  Two ways to the panel:

* ``panel_from_long`` - from a stored long table (B10 aggregate + join, B11);
* ``panel_from_export`` - straight from the export.  A wide row holds every
  wave of one family, so first/last wave is a projection; families are
  filtered and non-panel waves dropped *before* the unpivot and explode.
  With ``unique_key`` the whole panel is one map-only stage: no shuffle at
  all.  Otherwise a family may have several rows, and its waves come from an
  aggregate on the key.

With ``questions`` only those questions' columns are read and unpivoted.  A
row without a family key belongs to no family and is left out of the panel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.panel import first_last_wave, panel_first_last, waves_from_wide
from ..operators.reshape import (ColumnSpec, explode_assertions, map_profile, normalize_values,
                                 to_long)
from .survey import MIN_GAP, NA, NONE_LABEL


@dataclass(frozen=True)
class SurveySpec:
    key: str
    territory: str
    column_map: Sequence[ColumnSpec]
    anchor: str
    ids: Sequence[str] = ()
    profile: Mapping[str, tuple[str, Mapping[str, str]]] = field(default_factory=dict)
    min_gap: int = MIN_GAP
    sep_questions: Sequence[str] = ()
    territory_renames: Mapping[str, str] = field(default_factory=dict)
    multi_questions: Sequence[str] | None = None
    none_label: str = NONE_LABEL
    na: str = NA
    #: the export is known to have one row per family
    unique_key: bool = False


def _cells(wide: DataFrame, spec: SurveySpec, extra_ids: Sequence[str] = (),
           questions: Sequence[str] | None = None) -> DataFrame:
    wide = map_profile(wide, spec.profile)
    cells = [c for c in spec.column_map if questions is None or c.question in questions]
    return to_long(wide, cells, spec.key, spec.territory, list(spec.ids) + list(extra_ids))


def _tidy(long: DataFrame, spec: SurveySpec) -> DataFrame:
    long = normalize_values(long, spec.sep_questions, spec.territory_renames)
    return explode_assertions(long, na=spec.na, none_label=spec.none_label,
                              multi_questions=spec.multi_questions)


def long_table(wide: DataFrame, spec: SurveySpec, questions: Sequence[str] | None = None) -> DataFrame:
    """B4 -> B3 -> B5 -> B6: the tidy long table."""
    return _tidy(_cells(wide, spec, questions=questions), spec)


def kept_families(wide: DataFrame, spec: SurveySpec) -> DataFrame:
    """The export's rows of the families in the panel, with their first/last
    wave and profiles."""
    keyed = wide.filter(F.col(f"`{spec.key}`").isNotNull())
    return waves_from_wide(keyed, spec.column_map, spec.anchor, spec.min_gap, spec.na,
                           key=None if spec.unique_key else spec.key)


def periods_from_long(long: DataFrame, spec: SurveySpec) -> DataFrame:
    return first_last_wave(long, spec.anchor, spec.min_gap, spec.na)


def panel_from_long(long: DataFrame, spec: SurveySpec) -> DataFrame:
    return panel_first_last(periods_from_long(long, spec))


def periods_from_export(wide: DataFrame, spec: SurveySpec) -> DataFrame:
    """Long rows of the kept families with their first/last wave."""
    return _tidy(_cells(kept_families(wide, spec), spec, [S.TIME_FIRST, S.TIME_LAST]), spec)


def panel_from_export(wide: DataFrame, spec: SurveySpec, questions: Sequence[str] | None = None) -> DataFrame:
    cells = _cells(kept_families(wide, spec), spec, [S.TIME_FIRST, S.TIME_LAST], questions)
    cells = cells.filter((F.col(S.TIME) == F.col(S.TIME_FIRST)) | (F.col(S.TIME) == F.col(S.TIME_LAST)))
    return panel_first_last(_tidy(cells, spec))
