"""CSV files as typed tables.

Cells are read as text first: missing-value tokens become null before types are inferred, which
Spark's own inference cannot do in that order.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DELIMITERS, NA_TOKENS
from ..errors import EmptyTableError, LoadError
from ..functions.expressions import DECIMAL_SHAPE, INTEGER_SHAPE
from ..operators.structure import recommended_types
from ..plans.stats import aggregate
from ..plans.table import quoted
from .quick_scan import FIRST_LINE, PLAIN, delimiter_sql, per_file, text_lines

# A name no header has: the whole text of a row that has more or fewer cells than the header.
_RAW = "_raw_row"


@dataclass(frozen=True)
class _FileClass:
    """Files with the same header and encoding; open: whether a line leaves a quote open, perhaps the header itself."""

    header: str
    encoding: str
    open: bool
    open_header: bool
    files: list[str]


def encoding_check(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, valid_utf8, header): whether all lines of each file are UTF-8, and its first line."""
    return _checked(spark, paths, "auto").drop("open")


def _pattern(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def _open_sql(line: str, sep: str) -> str:
    """Whether a line that starts outside of quotes ends within them.

    A quote opens a cell at the start of a line or behind a delimiter only; elsewhere it is a letter.
    Whole quoted cells are taken out, from the left; a quote that still opens a cell has no end.
    """
    marks = "|".join(map(_pattern, DELIMITERS if sep == "auto" else [sep]))
    start = f"(^\\x{{feff}}?|{marks})\""
    open_cell = f"""rlike(regexp_replace({line}, r'{start}[^"]*+(?:""[^"]*+)*+"', '$1x'), r'{start}')"""
    return f"""(contains({line}, '"') and {open_cell})"""


def _checked(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    """(file, valid_utf8, header, open): no line of a file that is not open begins or ends within quotes."""
    return per_file(text_lines(spark, paths), [
        "not array_contains(collect_set(is_valid_utf8(value)), false) as valid_utf8",
        f"{FIRST_LINE} as header", f"bool_or({_open_sql('value', sep)}) as open",
    ])


def unclosed_quotes(spark: SparkSession, paths: str | list[str], *, sep: str = ",") -> DataFrame:
    """(file, unclosed): whether a file ends within quotes.

    A line maps the state before it (outside or within quotes) to the state behind it. The last line that
    leads to the same state from both decides, and the lines behind it that swap the two.
    """
    # A line without a quote leads to the state before it.
    quote = """contains(value, '"')"""
    lines = text_lines(spark, paths).selectExpr(
        "path", "block", "nth", f"{_open_sql('value', sep)} as from_out",
        f"""not {quote} or {_open_sql("concat('\"x', value)", sep)} as from_in""",
    )
    # Only numbers are kept per block, so lines are combined by hash: the place of a deciding line, and its state as last bit.
    blocks = aggregate(lines, ["path", "block"], ["max(if(from_out = from_in, shiftleft(nth, 1) + int(from_out), null)) as fixed"])
    last = aggregate(blocks, ["path"], [
        "max(if(fixed is null, null, struct(block, shiftright(fixed, 1) as nth, fixed % 2 = 1 as from_out))) as fixed"
    ])
    # A row per file, which the driver lists anyway.
    swaps = lines.where("from_out and not from_in").join(F.broadcast(last), "path").where(
        "fixed is null or block > fixed.block or block = fixed.block and nth > fixed.nth"
    )
    counted = aggregate(swaps, ["path"], ["count(1) as swaps"])
    return last.join(counted, "path", "left").selectExpr(
        f"{PLAIN.format('path')} as file", "coalesce(fixed.from_out, false) <> (coalesce(swaps, 0) % 2 = 1) as unclosed"
    )


def _file_classes(
    spark: SparkSession, paths: str | list[str], encoding: str, sep: str, multi_line: bool | None
) -> list[_FileClass]:
    """Which files can be read together. The driver lists files anyway; it learns their class."""
    checked = _checked(spark, paths, sep).selectExpr(
        "file",
        # In a file that is no UTF-8, bytes of the header may be lost: it is read again below.
        "if(valid_utf8, 'UTF-8', 'ISO-8859-1') as encoding" if encoding == "auto" else f"{quoted(encoding)} as encoding",
        "header",
        "open",
        f"open and {_open_sql('header', sep)} as open_header",
    )
    # A header of several lines is known once its file is read.
    kinds = ["header", "encoding", "open", "open_header", "alone"]
    per_class = aggregate(
        checked.selectExpr("*", "if(open_header, file, null) as alone"), kinds, ["sort_array(collect_list(file)) as files"]
    )
    classes = [
        _FileClass(r["header"], r["encoding"], r["open"], r["open_header"] and multi_line is not False, r["files"])
        for r in per_class.orderBy(*kinds).collect()
    ]
    if not classes:
        raise EmptyTableError(f"File is empty: {paths}")
    opened = [f for c in classes if c.open for f in c.files]
    if opened and multi_line is not False:
        never_closed = unclosed_quotes(spark, opened, sep=sep).where("unclosed").select("file").head(1)
        if never_closed:
            raise LoadError(f"A quote is never closed: {never_closed[0]['file']}")
    return classes


def header_names(header: str, sep: str) -> list[str]:
    """Column names of a header line: unnamed ones are numbered, repeated ones get a suffix."""
    return _unique_names(next(csv.reader([header.removeprefix("\ufeff")], delimiter=sep), []))


def _unique_names(cells: Iterable[str]) -> list[str]:
    names: list[str] = []
    for position, cell in enumerate(cells):
        base = cell if cell != "" else f"Unnamed: {position}"
        name, copy = base, 0
        while name in names:
            copy += 1
            name = f"{base}.{copy}"
        names.append(name)
    return names


def _cells_sql(raw: str, sep: str) -> str:
    """The cells of a row of CSV text, in SQL: an array of texts without their quotes."""
    mark = _pattern(sep)
    cell = f"""{mark}("(?:[^"]++|"")*+"(?:(?!{mark})[^\\n])*+|(?:(?!{mark})(?s:.))*+)"""
    # Every cell is looked for behind a delimiter, so the first one gets one as well.
    found = f"regexp_extract_all(concat({quoted(sep)}, {raw}), r'{cell}', 1)"
    inner = """replace(substring(x, 2, length(x) - 2), '""', '"')"""
    return f"""transform({found}, x -> if(length(x) > 1 and startswith(x, '"') and endswith(x, '"'), {inner}, x))"""


def _read_class(
    spark: SparkSession, found: _FileClass, sep: str, multi_line: bool | None
) -> tuple[DataFrame, list[str]]:
    """(file, c0.., raw, cells) as text, and the names of the columns.

    ``cells`` holds all cells of a row with a filled cell beyond the last column, else null.
    """
    header = found.header
    if found.encoding != "UTF-8":
        first = spark.read.option("encoding", found.encoding).option("sep", "\u0000").option("quote", "")
        header = first.csv(found.files[0]).limit(1).collect()[0][0]
    if sep == "auto":
        sep = spark.range(1).selectExpr(f"{delimiter_sql(quoted(header))} as sep").collect()[0]["sep"]
    if found.open_header:
        first = spark.read.options(sep=sep, escape='"', encoding=found.encoding, multiLine=True, emptyValue="")
        cells = [cell or "" for cell in first.csv(found.files[0]).limit(1).collect()[0]]
        names = _unique_names([cells[0].removeprefix("\ufeff"), *cells[1:]])
    else:
        names = header_names(header, sep)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    schema = schema.add(_RAW, T.StringType())
    reader = spark.read.schema(schema).options(
        header=True, sep=sep, escape='"', encoding=found.encoding, mode="PERMISSIVE", emptyValue="",
        multiLine=found.open if multi_line is None else multi_line, columnNameOfCorruptRecord=_RAW,
        columnPruning=False,  # else rows are measured by the columns that a plan needs
    )
    rows = reader.csv(found.files).selectExpr(f"{PLAIN.format('_metadata.file_path')} as file", "*")
    # Only rows that do not fit the header are split a second time. The length is always true: Spark
    # does not read the raw row without a column beside it.
    cells = f"if({_RAW} is null and coalesce(length(c0), 0) >= 0, null, {_cells_sql(_RAW, sep)})"
    beyond = f"exists(slice(cells, {len(names) + 1}, greatest(size(cells), 1)), x -> x <> '')"
    return rows.selectExpr("*", f"{cells} as cells").selectExpr("* except (cells)", f"if({beyond}, cells, null) as cells"), names


def _text_tables(
    spark: SparkSession, paths: str | list[str], sep: str, encoding: str, multi_line: bool | None
) -> list[tuple[list[str], list[tuple[_FileClass, DataFrame]]]]:
    """The names of each header, and the classes of files that have them with their rows."""
    tables: dict[tuple[str, ...], list[tuple[_FileClass, DataFrame]]] = {}
    for found in _file_classes(spark, paths, encoding, sep, multi_line):
        rows, names = _read_class(spark, found, sep, multi_line)
        tables.setdefault(tuple(names), []).append((found, rows))
    return [(list(names), parts) for names, parts in tables.items()]


def _text_table(
    spark: SparkSession, paths: str | list[str], sep: str, encoding: str, multi_line: bool | None
) -> tuple[DataFrame, list[str]]:
    tables = _text_tables(spark, paths, sep, encoding, multi_line)
    if len(tables) > 1:
        raise LoadError(f"The files have different headers: {paths}")
    names, parts = tables[0]
    return reduce(DataFrame.unionByName, [rows for _, rows in parts]), names


_TOKENS = ", ".join(map(quoted, NA_TOKENS))


def na_to_null(df: DataFrame) -> DataFrame:
    """The missing-value tokens of every text column become null."""
    cells = []
    for name, data_type in df.dtypes:
        cell = f"`{name.replace('`', '``')}`"
        cells.append(f"if({cell} in ({_TOKENS}), null, {cell}) as {cell}" if data_type == "string" else cell)
    return df.selectExpr(*cells)


# In order: the first type whose every value fits. A column without any value becomes double.
_TYPES = ("bigint", "decimal(20,0)", "double", "boolean")

# The types that fit a cell as bits in that order. Numbers begin below ':', but for infinity.
_FITS = f"""case
    when cell >= ':' then case
        when cell in ('true', 'True', 'TRUE', 'false', 'False', 'FALSE') then 8
        when (startswith(cell, 'i') or startswith(cell, 'I')) and rlike(cell, r'(?i)^inf(inity)?$') then 4
        else 0 end
    when rlike(cell, r'{INTEGER_SHAPE}') then case
        when try_cast(trim(cell) as bigint) >= 0 then 7
        when try_cast(trim(cell) as bigint) < 0 then 5
        when try_cast(trim(cell) as decimal(20,0)) between 0 and 18446744073709551615 then 6
        else 4 end
    when rlike(cell, r'{DECIMAL_SHAPE}') then 4
    when (startswith(cell, '+') or startswith(cell, '-')) and rlike(cell, r'(?i)^[+-]inf(inity)?$') then 4
    else 0 end"""


def _type_of(bits: str) -> str:
    """The type of a column in SQL, from the bits that all its cells have in common; null: it has no value."""
    whens = " ".join(f"when {bits} & {1 << i} <> 0 then {quoted(t)}" for i, t in enumerate(_TYPES))
    return f"case when {bits} is null then 'double' {whens} else 'string' end"


def _casts(df: DataFrame, value: str = "cell is not null") -> list[str]:
    """The columns of a table in SQL, text columns cast to what all their values are; ``value``: whether a cell has one."""
    names = [f"`{n.replace('`', '``')}`" for n in df.columns]
    text = [c for c, (_, t) in zip(names, df.dtypes) if t == "string"]
    if not text:
        return names
    cells = df.selectExpr(f"posexplode(array({', '.join(text)})) as (at, cell)").where(value)
    fits = aggregate(cells, ["at"], [f"bit_and({_FITS}) as bits"])
    # The driver reads one row per column.
    known = {r["at"]: r["type"] for r in fits.selectExpr("at", f"{_type_of('bits')} as type").collect()}
    wanted = {c: known.get(at, "double") for at, c in enumerate(text)}
    return [
        c if wanted.get(c, "string") == "string" else f"cast(trim({c}) as {wanted[c]}) as {c}" for c in names
    ]


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns cast to the first of integer, decimal, double and boolean that fits all values."""
    return df.selectExpr(*_casts(df))


def downcast(df: DataFrame) -> DataFrame:
    """Integer columns in the narrowest type that holds them. Floating ones keep their values."""
    narrower = {r["column"]: r["recommended"] for r in recommended_types(df).collect()}
    cells = [f"`{n.replace('`', '``')}`" for n in df.columns]
    return df.selectExpr(
        *[f"cast({c} as {narrower[n]}) as {c}" if n in narrower else c for n, c in zip(df.columns, cells)]
    )


def _fitting(rows: DataFrame, width: int, on_bad_rows: str) -> DataFrame:
    """The rows of a table as wide as its header; others are an error or left out."""
    if on_bad_rows not in ("error", "drop"):
        raise ValueError("on_bad_rows is 'error' or 'drop'")
    if on_bad_rows == "drop":
        rows = rows.where("cells is null")
    else:
        message = quoted(f"a row has more cells than the header: expected {width}")
        rows = rows.where(f"if(cells is null, true, raise_error({message}))")
    # A line of white space only is no row; blank cells with delimiters between them are one.
    line = _RAW if width > 1 else "c0"
    return rows.where(f"{line} is null or trim({line}) <> ''")


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    *,
    sep: str = ",",
    encoding: str = "auto",
    multi_line: bool | None = None,
    on_bad_rows: str = "error",
    typed: bool = True,
    narrow: bool = False,
    file_column: str | None = None,
) -> DataFrame:
    """One table from CSV files with the same header.

    ``encoding="auto"`` reads files that are no UTF-8 as Latin-1. ``sep="auto"`` takes the
    delimiter from the header. Files in which a line leaves a quote open are read as a whole each, for
    line breaks within quotes (``multi_line=None``); True or False holds for all files. A quote that is never
    closed is an error (but for ``multi_line=False``). A row with too few cells is filled with missing ones; one with more
    (a cell that is not empty beyond the last column) is an error, or left out with ``on_bad_rows="drop"`` (see ``bad_rows``).
    """
    rows, names = _text_table(spark, paths, sep, encoding, multi_line)
    rows, columns = _fitting(rows, len(names), on_bad_rows), [f"c{i}" for i in range(len(names))]
    if rows.isEmpty():
        raise EmptyTableError(f"File is empty: {paths}")
    # Tokens are looked for once per cell, behind the generator, not in the code of every column.
    casts = _casts(rows.select(*columns), f"cell not in ({_TOKENS})") if typed else columns
    # The file name is no cell: neither a missing-value token nor a number.
    file = [] if file_column is None else ["file"]
    table = na_to_null(rows.select(*columns, *file)).selectExpr(*file, *casts)
    table = table.toDF(*[file_column] * len(file), *names)
    return downcast(table) if narrow else table


def bad_rows(
    spark: SparkSession, paths: str | list[str], *, sep: str = ",", encoding: str = "auto", multi_line: bool | None = None
) -> DataFrame:
    """(file, cells): the rows with a filled cell beyond the header's last column, with all their cells."""
    rows, _ = _text_table(spark, paths, sep, encoding, multi_line)
    return rows.where("cells is not null").select("file", "cells")


def profile_files(
    spark: SparkSession,
    paths: str | list[str],
    operator: Callable[..., DataFrame],
    *,
    per: str = "file",
    csv_options: dict | None = None,
    **options,
) -> DataFrame:
    """An operator's result per file, from one job over all files.

    ``per`` is a SQL expression over ``file``, such as one that takes the day out of the path; the
    result is per value of it. Files may have different headers, and each has the types of its own cells.
    Files of one value of ``per`` are one table, so they need the same header.
    """
    tables = tables_by_schema(spark, paths, per=per, **(csv_options or {}))
    return reduce(DataFrame.unionByName, [operator(table, group_cols=["file"], **options) for table in tables])


def tables_by_schema(
    spark: SparkSession,
    paths: str | list[str],
    *,
    per: str = "file",
    sep: str = ",",
    encoding: str = "auto",
    multi_line: bool | None = None,
    on_bad_rows: str = "error",
) -> list[DataFrame]:
    """One table per header and list of types, each with ``file``, the value of ``per``, in front.

    Types are inferred for each value of ``per``, all files of a header in one scan. The driver reads a row per
    list of types.
    """
    found = _text_tables(spark, paths, sep, encoding, multi_line)
    listed = [(f, n) for n, (_, parts) in enumerate(found) for of, _ in parts for f in of.files]
    headers = spark.createDataFrame(listed, "file string, header int").selectExpr(f"{per} as file", "header")
    torn = aggregate(headers, ["file"], ["count(distinct header) as headers"]).where("headers > 1").head(1)
    if torn:
        raise LoadError(f"The files of {torn[0]['file']} have different headers: {paths}")
    made = []
    for names, parts in found:
        columns = [f"c{i}" for i in range(len(names))]

        def cells(parts: list[tuple[_FileClass, DataFrame]]) -> DataFrame:
            rows = reduce(DataFrame.unionByName, [rows for _, rows in parts])
            # The file name is no cell, so it is put beside the cells once they are cleaned.
            kept = _fitting(rows, len(columns), on_bad_rows).selectExpr("struct(file) as at_file", *columns)
            return na_to_null(kept).selectExpr("at_file.file as file", *columns)

        for types, files in _types_of_files(cells(parts), columns, per):
            chosen = [
                _read_class(spark, replace(of, files=own), sep, multi_line)[0]
                for of, _ in parts if (own := [f for f in of.files if f in files])
            ]
            casts = [c if t == "string" else f"cast(trim({c}) as {t}) as {c}" for c, t in zip(columns, types)]
            table = cells([(of, rows) for (of, _), rows in zip(parts, chosen)])
            made.append(table.selectExpr(f"{per} as file", *casts).toDF("file", *names))
    if not made:
        raise EmptyTableError(f"File is empty: {paths}")
    return made


def _types_of_files(cells: DataFrame, columns: list[str], per: str) -> list[tuple[list[str], set[str]]]:
    """Each list of column types, and the files that have it."""
    long = cells.selectExpr("file", f"posexplode(array({', '.join(columns)})) as (at, cell)")
    # Per file first, so that a row has no more than numbers to combine.
    of_files = aggregate(long, ["file", "at"], [f"bit_and(if(cell is null, null, {_FITS})) as bits"])
    fits = aggregate(of_files.selectExpr("*", f"{per} as of"), ["of", "at"], [
        "bit_and(bits) as bits", "collect_set(if(at = 0, file, null)) as files",
    ])
    typed = fits.selectExpr("of", "at", "files", f"{_type_of('bits')} as type")
    signed = aggregate(typed, ["of"], ["array_sort(collect_list(struct(at, type))) as types", "flatten(collect_list(files)) as files"])
    classes = aggregate(signed, ["types"], ["flatten(collect_list(files)) as files"]).orderBy("types").collect()
    return [([t["type"] for t in r["types"]], set(r["files"])) for r in classes]
