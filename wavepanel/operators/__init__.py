"""The panel-survey operators; each takes and returns DataFrames."""

from .panel import (family_waves, first_last_wave, one_answer_per_family, panel_first_last,
                    period_distribution, profile_conflicts, respondents_by_territory, waves_from_wide)
from .quantiles import exact_quantiles
from .recode import (answer_order, composite_flags, find_values, in_category_order, recode_answers,
                     unrecoded_report)
from .reshape import (ColumnSpec, build_column_map, explode_assertions, map_profile,
                      normalize_values, to_long)
from .stats import (association_matrix, contingency_table, cramers_v, group_describe, histogram_equal_width,
                    histogram_fixed_width, income_per_capita)
from .tables import (assertion_counts, descriptive_table, frequency_by_flag, frequency_table,
                     missing_table)
from .transitions import (grouped_transitions, paired_scores, paired_scores_summary,
                          transition_matrix, transition_pairs)

__all__ = [
    "ColumnSpec", "build_column_map", "to_long", "map_profile", "normalize_values", "explode_assertions",
    "recode_answers", "answer_order", "in_category_order", "composite_flags", "find_values", "unrecoded_report",
    "family_waves", "first_last_wave", "waves_from_wide", "panel_first_last", "period_distribution",
    "respondents_by_territory", "one_answer_per_family", "profile_conflicts",
    "frequency_table", "missing_table", "frequency_by_flag", "descriptive_table", "assertion_counts",
    "transition_pairs", "transition_matrix", "grouped_transitions", "paired_scores", "paired_scores_summary",
    "cramers_v", "contingency_table", "association_matrix", "histogram_equal_width", "histogram_fixed_width",
    "income_per_capita", "group_describe", "exact_quantiles",
]
