"""Wide questionnaire export -> tidy long table.

The column map is schema metadata (one entry per physical column of the
export), so it is applied on the driver to choose and label the columns to
unpivot; the data itself never leaves the executors.  Profile lookups run on
the wide rows (once per family), not on the long rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.answers import assertions, lookup, replace_values, sql_text
from ..plans.survey import NA, NONE_LABEL

_LOGICAL = re.compile(r"([^_]*)_T(\d)$")


class ColumnSpec(NamedTuple):
    original_column: str
    column: str
    question: str | None
    time: int | None


def logical_parts(column: str) -> tuple[str | None, int | None]:
    """'Walls_T0' -> ('Walls', 0); 'A_B_T3' -> ('B', 3); no wave suffix -> (None, None)."""
    m = _LOGICAL.search(column)
    if not m:
        return None, None
    return m.group(1), int(m.group(2))


def build_column_map(explicit: Mapping[str, str] | None = None,
                     stems: Sequence[str] = (), waves: Iterable[int] = ()) -> list[ColumnSpec]:
    """B2: physical column -> logical ``Question_T<w>``.

    ``stems`` are physical names without the wave suffix; each gets one entry
    per wave, its logical name being the part after the last '_'.  Explicit
    entries win over generated ones with the same physical name.  Two physical
    columns may share a logical name (both are kept).
    """
    mapping: dict[str, str] = {}
    waves = list(waves)
    for stem in stems:
        short = stem.split("_")[-1]
        for w in waves:
            mapping[f"{stem}_T{w}"] = f"{short}_T{w}"
    mapping.update(explicit or {})
    out = []
    for original, logical in mapping.items():
        q, t = logical_parts(logical)
        out.append(ColumnSpec(original, logical, q, t))
    return out


def column_map_frame(spark, column_map: Sequence[ColumnSpec]) -> DataFrame:
    return spark.createDataFrame(
        [tuple(c) for c in column_map],
        "original_column string, column string, question string, time int")


def map_profile(wide: DataFrame, profile: Mapping[str, tuple[str, Mapping[str, str]]],
                drop_source: bool = True) -> DataFrame:
    """Normalise profile answers by dictionary lookup on the wide rows.

    ``profile`` maps a source column to (output name, {raw: value}); a raw
    value outside the dictionary (or null) becomes null.
    """
    cols = {alias: lookup(src, mapping) for src, (alias, mapping) in profile.items()
            if src in wide.columns}
    out = wide.withColumns(cols)
    if drop_source:
        out = out.drop(*[src for src in profile if src in wide.columns and src not in cols])
    return out


def to_long(wide: DataFrame, column_map: Sequence[ColumnSpec], key: str, territory: str,
            ids: Sequence[str] = ()) -> DataFrame:
    """Unpivot the mapped question columns into one row per (family, cell).

    Only physical columns present in both the export and the map are read;
    unmapped columns never reach the unpivot.  Each cell keeps its raw string
    answer (nulls included; ``explode_assertions`` drops them).
    """
    present = set(wide.columns)
    cells = [c for c in column_map if c.original_column in present]
    if not cells:
        raise ValueError("no column of the column map is present in the export")
    # one text for all cells: a call to the JVM for each took longer than the unpivot
    entries = ", ".join(
        f"struct({sql_text(c.original_column)}, {sql_text(c.column)}, cast({sql_text(c.question)} as string), "
        f"cast({'null' if c.time is None else c.time} as int), cast({_quote(c.original_column)} as string))" for c in cells)
    names = ", ".join((S.ORIGINAL_COLUMN, f"`{S.COLUMN}`", S.QUESTION, f"`{S.TIME}`", S.ANSWER))
    keep = [f"cast({_quote(key)} as string) as {S.FAMILY}", f"{_quote(territory)} as {S.TERRITORY}", *map(_quote, ids)]
    return (wide.selectExpr(*keep, f"inline(array({entries})) as ({names})")
            .select(S.FAMILY, S.TERRITORY, *map(_quote, ids), S.TIME, S.QUESTION, S.ANSWER,
                    S.COLUMN, S.ORIGINAL_COLUMN))


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def normalize_values(long: DataFrame, sep_questions: Sequence[str] = (),
                     territory_renames: Mapping[str, str] | None = None,
                     from_sep: str = ",", to_sep: str = ";") -> DataFrame:
    """Use ';' as the assertion separator everywhere; rename territories."""
    out = long
    if sep_questions:
        out = out.withColumn(S.ANSWER, F.when(
            F.col(S.QUESTION).isin(list(sep_questions)),
            F.replace(F.col(S.ANSWER), F.lit(from_sep), F.lit(to_sep))).otherwise(F.col(S.ANSWER)))
    if territory_renames:
        out = out.withColumn(S.TERRITORY, replace_values(S.TERRITORY, territory_renames))
    return out


def explode_assertions(long: DataFrame, sep: str = ";", na: str = NA,
                       none_label: str = NONE_LABEL,
                       multi_questions: Sequence[str] | None = None) -> DataFrame:
    """One row per ticked assertion, in one pass over the data.

    'NA' stays one 'NA' row, an all-'NA' list becomes ``none_label``, 'NA'
    slots of a partly answered list are dropped and a null answer yields no
    row.  With ``multi_questions`` only those questions are split.
    """
    arr = assertions(S.ANSWER, sep=sep, na=na, none_label=none_label)
    if multi_questions is not None:
        arr = F.when(F.col(S.QUESTION).isin(list(multi_questions)), arr).otherwise(
            F.when(F.col(S.ANSWER).isNotNull(), F.array(F.col(S.ANSWER))))
    cols = [F.explode(arr).alias(S.ANSWER) if c == S.ANSWER else F.col(_quote(c))
            for c in long.columns]
    return long.select(*cols)
