"""A look at delimited text files by their lines, before anything is parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..constants import DELIMITERS
from ..errors import LoadError
from ..functions.expressions import blank_sql
from ..plans.stats import aggregate
from ..plans.table import quoted


# Spark names a local file in two ways, and blanks and other letters of a path by their codes.
PLAIN = "regexp_replace(url_decode(replace({}, '+', '%2B')), '^file:/+', 'file:/')"


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, file_size, block, nth, value): the lines of text files with their place; ``PLAIN`` names the file of a path."""
    try:
        lines = spark.read.text(paths)
    except AnalysisException as e:
        raise LoadError(f"File not found: {paths}") from e
    return lines.selectExpr(
        "_metadata.file_path as path", "_metadata.file_size as file_size",
        "_metadata.file_block_start as block", "monotonically_increasing_id() as nth", "value",
    )


def per_file(lines: DataFrame, aggregates: list[str]) -> DataFrame:
    """(file, aggregates...): the name of a file is made once per file and task, not per line."""
    made = aggregate(lines, ["path"], aggregates)
    return made.selectExpr(f"{PLAIN.format('path')} as file", "* except (path)")


# The line a file starts with: the first one of its first block. Beside a ``collect_set`` Spark aggregates texts
# by hash; alone, it would sort all lines by their file first.
FIRST_LINE = "min_by(value, struct(block, nth))"


def delimiter_sql(header: str) -> str:
    """The most frequent candidate in a header; ties go to the first, none at all to the comma."""
    counted = ", ".join(
        f"struct(length({header}) - length(replace({header}, {quoted(d)}, '')) as hits, {-i} as rank, {quoted(d)} as mark)"
        for i, d in enumerate(DELIMITERS)
    )
    return f"array_max(array({counted})).mark"


def detect_delimiter(headers: DataFrame, header: str = "header") -> DataFrame:
    """The table of headers with ``delimiter`` and ``columns``, the parts the header splits into."""
    named = headers.selectExpr("*", f"{delimiter_sql(f'`{header}`')} as delimiter")
    parts = f"length(`{header}`) - length(replace(`{header}`, delimiter, '')) + 1"
    return named.selectExpr("*", f"cast({parts} as bigint) as columns")


def quick_scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, rows, columns, delimiter, file_size_kb) per file.

    Rows are non-blank lines behind the first one, so a line break within quotes counts. Lines are
    counted per file within each task; only counts and candidate headers are shuffled.
    """
    counted = per_file(
        text_lines(spark, paths),
        [f"count_if(not {blank_sql('value')}) as filled", f"{FIRST_LINE} as header", "array_max(collect_set(file_size)) as size"],
    )
    found = detect_delimiter(counted).selectExpr(
        "file", f"filled - if({blank_sql('header')}, 0, 1) as rows", "columns", "delimiter", "size"
    )
    # An empty file has no line at all, but is a file. The driver lists the files in any case.
    files = [(f,) for f in spark.read.text(paths).inputFiles()]
    listed = spark.createDataFrame(files, "file string").selectExpr(f"{PLAIN.format('file')} as file")
    return listed.join(found, "file", "left").selectExpr(
        "file", "coalesce(rows, 0) as rows", "coalesce(columns, 0) as columns",
        "coalesce(delimiter, ',') as delimiter", "coalesce(size, 0) / 1024D as file_size_kb",
    )
