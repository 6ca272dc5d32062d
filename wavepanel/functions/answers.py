"""Column expressions shared by the operators.

Everything here builds a ``Column`` from built-in functions, so it stays in
whole-stage codegen; nothing runs Python per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.survey import NA, NO, NONE_LABEL, YES


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def assertions(answer: str | Column, sep: str = ";", na: str = NA,
               none_label: str = NONE_LABEL) -> Column:
    """Array of the assertions ticked in one raw answer.

    'NA' -> ['NA'] (asked, not answered); 'NA;NA;...;NA' -> [none_label]
    (answered, nothing ticked); otherwise the ';' split with the 'NA' slots
    removed.  Empty slots survive, nothing is trimmed, and a null answer gives
    a null array (no row after explode).
    """
    a = col(answer)
    s = _regex_quote(sep)
    n = _regex_quote(na)
    all_na = f"^({n}{s})+{n}\\z"
    # array_remove drops every 'NA' slot; unlike a filter lambda it keeps
    # the explode inside whole-stage codegen
    return (
        F.when(a == F.lit(na), F.array(F.lit(na)))
        .when(a.rlike(all_na), F.array(F.lit(none_label)))
        .otherwise(F.array_remove(F.split(a, s, -1), F.lit(na)))
    )


def _regex_quote(text: str) -> str:
    out = []
    for ch in text:
        out.append("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch)
    return "".join(out)


def is_answered(c: str | Column, na: str = NA) -> Column:
    """True for a value that is neither null nor the 'NA' marker."""
    x = col(c)
    return x.isNotNull() & (x != F.lit(na))


def as_number(c: str | Column) -> Column:
    """String answer -> double; anything that is not a number becomes null."""
    return F.expr(f"try_cast({_sql_ref(c)} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def _sql_ref(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str | int | None) -> str:
    """A string or whole number as a SQL literal."""
    if value is None:
        return "null"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(c: str | Column, mapping: Mapping[str, str | int]) -> Column:
    """Value of ``c`` looked up in a small literal dictionary; unmapped -> null."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in mapping.items())
    return F.try_element_at(F.expr(f"map({pairs})"), col(c))


def replace_values(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Replace values found in ``mapping``; every other value is kept."""
    x = col(c)
    return F.coalesce(lookup(x, mapping), x) if mapping else x


def collapse(c: str | Column, groups: Mapping[str, Sequence[str]], other: str | None = None,
             keep_missing: bool = True, na: str = NA) -> Column:
    """Map values to groups ({group: [values]}).

    Values in no group become ``other`` (or stay as they are when ``other`` is
    None).  With ``keep_missing`` a null or 'NA' value is never put in a group.
    """
    x = col(c)
    flat = {v: g for g, vs in groups.items() for v in vs}
    mapped = lookup(x, flat)
    rest = F.lit(other) if other is not None else x
    out = F.coalesce(mapped, rest)
    if keep_missing:
        out = F.when(x.isNull(), F.lit(None).cast("string")).when(x == F.lit(na), F.lit(na)).otherwise(out)
    return out


def both_yes(a: str | Column, b: str | Column, yes: str = YES, no: str = NO) -> Column:
    """yes if a and b are both yes, no if that is false, null if undecidable.

    SQL three-valued logic: null & false = false, null & true = null.
    """
    cond = (col(a) == F.lit(yes)) & (col(b) == F.lit(yes))
    return F.when(cond, F.lit(yes)).when(~cond, F.lit(no))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 as double; null when whole is 0 or null."""
    return F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))
