"""Moments and counters per column: one scan, one partial aggregate per task, no row shuffled.

The aggregate is built in the wide layout (one aggregate expression per column and measure), which
Spark evaluates in generated code without exploding rows. Generated code beyond a certain size is
not compiled by the JVM, so columns are cut into chunks; a columnar source reads each column in
one chunk only, so the input is still read once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import blank_sql
from .table import FLOAT, INTEGRAL, NUMERIC_KINDS, TEXT, VARIANT, Field, Table

COLUMNS_PER_SCAN = 4

# measure -> (type, kinds of column it exists for (None: all), SQL aggregate of column c, double d)
MEASURES: dict[str, tuple[str, tuple[str, ...] | None, str]] = {
    "rows": ("bigint", None, "count(1)"),
    "missing": ("bigint", None, "count(1) - count({c})"),
    "filled": ("bigint", None, "count({c})"),
    "bytes": ("bigint", None, ""),
    "low": ("double", NUMERIC_KINDS, "min({d})"),
    "high": ("double", NUMERIC_KINDS, "max({d})"),
    # Infinite values are no part of a histogram: its ends are finite.
    "first_edge": ("double", NUMERIC_KINDS, "min(if(abs({d}) < double('Infinity'), {d}, null))"),
    "last_edge": ("double", NUMERIC_KINDS, "max(if(abs({d}) < double('Infinity'), {d}, null))"),
    # NaN is missing from here on.
    "non_finite": ("bigint", NUMERIC_KINDS, "count_if(abs({d}) = double('Infinity'))"),
    # Whether two values differ; of texts and nested values, whether their hashes do.
    "differs": ("boolean", None, "coalesce(min({k}) < max({k}), false)"),
    "low_whole": ("bigint", (INTEGRAL,), "min({c})"),
    "high_whole": ("bigint", (INTEGRAL,), "max({c})"),
    "integral": ("boolean", NUMERIC_KINDS, "coalesce(bool_and({d} % 1 = 0), false)"),
    "negatives": ("bigint", NUMERIC_KINDS, "count_if({d} < 0)"),
    "skew": ("double", NUMERIC_KINDS, "skewness({d})"),
    "kurt": ("double", NUMERIC_KINDS, "kurtosis({d})"),
    "avg_length": ("double", (TEXT,), "avg(length({c}))"),
    "min_length": ("int", (TEXT,), "min(length({c}))"),
    "max_length": ("int", (TEXT,), "max(length({c}))"),
    "blank": ("bigint", (TEXT,), "count_if({blank})"),
    # The leading type name only, so the set is bounded by the number of variant types. A JSON null is
    # a missing value, not a type.
    "variant_types": (
        "int", (VARIANT,), "size(collect_set(nullif(regexp_extract(schema_of_variant({c}), '^[A-Z]+', 0), 'VOID')))"
    ),
}
# For these the column itself is the finite one: integers and decimals have no infinity.
_SAME_AS = {"first_edge": "low", "last_edge": "high"}


def _aggregate(f: Field, measure: str) -> str:
    if measure == "bytes":
        if f.width is not None:
            # Fixed width, missing cells included, as in a columnar buffer.
            return f"count(1) * {f.width}"
        whole = f.kind == TEXT or isinstance(f.data_type, T.BinaryType)
        return f"coalesce(sum(octet_length({f.sql if whole else f.key_text})), 0)"
    if measure == "integral" and f.kind == INTEGRAL:
        return f"count({f.sql}) > 0"
    if measure == "non_finite" and f.kind != FLOAT:
        return "0L * count(1)"
    if f.kind != FLOAT:
        measure = _SAME_AS.get(measure, measure)
    return MEASURES[measure][2].format(c=f.sql, d=f.number, k=f.sql if f.ordered else f.key_hash, blank=blank_sql(f.sql))


def column_stats(table: Table, measures: Iterable[str], fields: list[Field] | None = None) -> DataFrame:
    """One row per group and column: ``slot`` and the asked measures."""
    measures = list(dict.fromkeys(measures))
    fields = table.fields if fields is None else fields
    if not fields:
        return table.empty("slot int, " + ", ".join(f"{m} {MEASURES[m][0]}" for m in measures))
    # Few measures leave room for more columns in one aggregate.
    size = max(COLUMNS_PER_SCAN, COLUMNS_PER_SCAN * 8 // len(measures))
    chunks = [fields[i : i + size] for i in range(0, len(fields), size)]
    return reduce(DataFrame.unionByName, [_scan(table, chunk, measures) for chunk in chunks])


def _scan(table: Table, fields: list[Field], measures: list[str]) -> DataFrame:
    names: dict[str, str] = {}
    rows = []
    for f in fields:
        cells = [f"{f.slot} as slot"]
        for m in measures:
            data_type, kinds, _ = MEASURES[m]
            if kinds is not None and f.kind not in kinds:
                cells.append(f"cast(null as {data_type}) as {m}")
                continue
            name = names.setdefault(_aggregate(f, m), f"a{len(names)}")
            cells.append(f"cast({name} as {data_type}) as {m}")
        rows.append(f"struct({', '.join(cells)})")
    keys = table.groups
    grouped = aggregate(table.df, keys, [f"{sql} as {name}" for sql, name in names.items()] or ["count(1) as a0"])
    return grouped.selectExpr(*keys, f"inline(array({', '.join(rows)}))")


def aggregate(df: DataFrame, keys: list[str], aggregates: list[str]) -> DataFrame:
    """GROUP BY keys with aggregates given in SQL; without keys one row, also of an empty table."""
    return df.groupBy(*keys).agg(*map(F.expr, aggregates))
