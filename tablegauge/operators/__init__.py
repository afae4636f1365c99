"""The measurements. Each takes a DataFrame (or a Profile) and returns a long DataFrame.

Options of every operator: ``columns`` (default: all), ``group_cols`` (results per group),
``mode`` ("exact" or "approx") and ``thresholds``.
"""

from .names import id_like_name, names_of, target_names, word_lists
from .numeric import (
    boxplot_outliers,
    boxplot_stats,
    chartable_columns,
    correlated_columns,
    correlation_matrix,
    distribution_shape,
    histogram,
    iqr_bounds,
    negative_in_nonnegative,
    non_finite_values,
    outliers,
    outliers_iqr,
    outliers_mad,
)
from .history import column_states, merge_states
from .report import full_profile, json_safe, profile_tables, report_json, write_profile
from .score import deduction, findings, health_score, quality_gate, score_breakdown
from .structure import (
    column_types,
    constant_columns,
    duplicate_columns,
    duplicate_rows,
    high_cardinality,
    memory_usage,
    missing_percentage,
    missing_values,
    near_constant_columns,
    possible_target_columns,
    recommended_types,
    sequential_integers,
    shape,
    unique_counts,
)
from .text import date_like_columns, lexical_types, mixed_type_columns, text_column_stats

__all__ = [
    "boxplot_outliers", "boxplot_stats", "chartable_columns", "column_states", "column_types", "constant_columns",
    "correlated_columns", "correlation_matrix", "date_like_columns", "deduction", "distribution_shape",
    "duplicate_columns", "duplicate_rows", "findings", "full_profile", "health_score", "high_cardinality",
    "histogram", "id_like_name", "iqr_bounds", "json_safe", "lexical_types", "memory_usage",
    "merge_states", "non_finite_values",
    "missing_percentage", "missing_values", "mixed_type_columns", "names_of", "near_constant_columns",
    "negative_in_nonnegative", "outliers", "outliers_iqr", "outliers_mad", "possible_target_columns",
    "profile_tables", "quality_gate", "recommended_types", "report_json", "score_breakdown",
    "sequential_integers", "shape", "target_names", "text_column_stats", "unique_counts", "word_lists",
    "write_profile",
]
