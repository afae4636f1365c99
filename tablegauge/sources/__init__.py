"""Tables from CSV files, a quick look at such files, and a messy test table."""

from .csv_files import (
    bad_rows,
    downcast,
    encoding_check,
    infer_types,
    na_to_null,
    profile_files,
    read_csv,
    tables_by_schema,
    unclosed_quotes,
)
from .messy import generate_messy
from .quick_scan import detect_delimiter, quick_scan

__all__ = [
    "bad_rows", "detect_delimiter", "downcast", "encoding_check", "generate_messy", "infer_types", "na_to_null",
    "profile_files", "quick_scan", "read_csv", "tables_by_schema", "unclosed_quotes",
]
