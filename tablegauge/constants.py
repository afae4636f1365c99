"""Fixed values that define what the measurements mean.

They are the default thresholds, word lists and message formats of the report; every
operator takes the numeric ones as arguments.
"""

from __future__ import annotations

from dataclasses import dataclass

# Names that mark a column.
ID_NAME_WORDS = ("id", "uuid", "guid", "key", "code", "number", "num", "no", "index", "idx", "ref")
TARGET_NAME_WORDS = (
    "target", "label", "labels", "class", "outcome", "churn",
    "response", "result", "diagnosis", "prediction", "output",
)
NONNEGATIVE_KEYWORDS = ("count", "age", "price", "quantity", "amount", "qty", "total")

# Text tokens that a CSV reader takes as "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Delimiters a header is searched for, in order of preference.
DELIMITERS = (",", ";", "\t", "|")

# Most points a category may cost, in report order (sum 100).
DEDUCTION_CAPS = {
    "missing_values": 25,
    "duplicate_rows": 20,
    "outliers": 15,
    "duplicate_columns": 10,
    "constant_columns": 10,
    "mixed_type_columns": 5,
    "negative_values": 5,
    "skewed_distributions": 5,
    "correlated_columns": 5,
}

# Lowest score of each grade.
GRADES = ((90, "Excellent"), (75, "Good"), (60, "Fair"), (40, "Poor"), (0, "Critical"))

# The findings in report order: rule, severity, printf format of the sentence.
FINDING_RULES = (
    ("missingness", "danger", "🚨 Column '%s' has high missingness (%s%%)."),
    ("constant", "warning", "⚠️ Column '%s' is constant (no variation)."),
    ("near_constant", "", "🔁 Column '%s' is nearly constant (one value dominates almost all rows)."),
    ("possible_target", "", "🎯 Column '%s' looks like it could be the modeling target."),
    ("id_like", "", "🆔 Column '%s' looks like an ID (very high uniqueness)."),
    ("outliers", "", "📊 Column '%s' has %s potential outlier(s) (%s method)."),
    ("duplicate_columns", "", "🧬 Columns '%s' and '%s' are identical."),
    ("correlated", "", "🔗 Columns '%s' and '%s' are highly correlated (%s)."),
    ("date_like", "", "📅 Column '%s' looks like it contains dates (consider parsing as datetime)."),
    ("mixed_type", "", "🧩 Column '%s' contains mixed data types."),
    ("negative", "", "➖ Column '%s' contains unexpected negative values."),
    ("skewed", "", "📐 Column '%s' is heavily skewed (skew=%s)."),
)


@dataclass(frozen=True)
class Thresholds:
    """Decision lines of the detectors. The defaults are fixed values."""

    high_cardinality: float = 0.9
    min_unique: int = 10
    near_constant: float = 0.95
    correlation: float = 0.9
    iqr_multiplier: float = 1.5
    mad_z_constant: float = 0.6745
    mad_outlier: float = 3.5
    skewness: float = 2.0
    date_ratio: float = 0.8
    missing_percentage: float = 30.0
    histogram_bins: int = 10
    boxplot_points: int = 50
