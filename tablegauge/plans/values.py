"""Value frequencies: one row per group, column and distinct value, with its count.

Rows are exploded to (column, value) cells and counted. The count is combined before the shuffle,
so a value that fills a whole column crosses the network once per task; every other operator that
needs values (quantiles, outliers, histograms, distinct counts) then works on distinct values,
weighted by their count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import DECIMAL_SHAPE, is_date_text, lexical_class
from .stats import aggregate
from .table import DECIMAL, FLOAT, INTEGRAL, Field, Table

# Texts of this many bytes or more are represented by a mark and their SHA-256 digest, unless they may
# spell a number, a truth value or a date: all of these but numbers are shorter once trimmed. What is
# kept as it is never looks like a marked digest.
DIGEST_FROM = 64


def _key(text: str) -> str:
    plain = f"octet_length({text}) < {DIGEST_FROM} or octet_length(trim({text})) < {DIGEST_FROM} or rlike({text}, r'{DECIMAL_SHAPE}')"
    return f"if({plain}, {text}, concat('sha256:', sha2({text}, 256)))"


LEXICAL_CLASSES = ("integer", "decimal", "boolean", "date", "text")


def _cells(table: Table, fields: list[Field], values: list[str], *columns: str) -> DataFrame:
    """Non-missing cells of columns of one type: (groups, slot, columns...)."""
    exploded = table.df.selectExpr(*table.groups, f"posexplode(array({', '.join(values)})) as (at, cell)")
    slots = ", ".join(str(f.slot) for f in fields)
    return exploded.where("cell is not null").selectExpr(
        *table.groups, f"element_at(array({slots}), at + 1) as slot", *columns
    )


def numeric_cells(table: Table, fields: list[Field]) -> DataFrame:
    """(groups, slot, whole, value): ``whole`` keeps integers exact, ``value`` is the double."""
    parts = []
    for kind, data_type, whole in (
        (INTEGRAL, "bigint", "cell"), (FLOAT, "double", "cast(null as bigint)"), (DECIMAL, "double", "cast(null as bigint)")
    ):
        chosen = [f for f in fields if f.kind == kind]
        if chosen:
            values = [f"cast({f.sql} as {data_type})" for f in chosen]
            parts.append(_cells(table, chosen, values, f"{whole} as whole", "cast(cell as double) as value"))
    if not parts:
        return table.empty("slot int, whole bigint, value double")
    return reduce(DataFrame.unionByName, parts)


def numeric_values(table: Table, fields: list[Field]) -> DataFrame:
    """(groups, slot, whole, value, cnt) of the numeric columns."""
    cells = numeric_cells(table, fields)
    return aggregate(cells, [*table.groups, "slot", "whole", "value"], ["count(1) as cnt"])


def text_values(table: Table, fields: list[Field]) -> DataFrame:
    """(groups, slot, value, cnt) of other columns; ``value`` is a text or the digest of one."""
    if not fields:
        return table.empty("slot int, value string, cnt bigint")
    keys = []
    for f in fields:
        fixed = f.width is not None
        text = f.key_text
        keys.append(text if fixed else _key(text))
    cells = _cells(table, fields, keys, "cell as value")
    return aggregate(cells, [*table.groups, "slot", "value"], ["count(1) as cnt"])


def distinct_from(table: Table, values: DataFrame) -> DataFrame:
    """(groups, slot, uniques, top) from frequencies."""
    return aggregate(values, [*table.groups, "slot"], ["count(1) as uniques", "max(cnt) as top"])


def distinct_stats(table: Table, fields: list[Field], numeric: DataFrame | None = None) -> DataFrame:
    """Distinct values per column and the count of the most frequent one.

    ``numeric`` may pass known frequencies. A column without any value has no row here. Decimals
    are counted by their text, for as doubles some would be merged.
    """
    by_number = [f for f in fields if f.kind in (INTEGRAL, FLOAT)]
    by_text = [f for f in fields if f.kind not in (INTEGRAL, FLOAT)]
    parts = []
    if by_number:
        known = numeric_values(table, by_number) if numeric is None else numeric.where(table.among(by_number))
        parts.append(distinct_from(table, known))
    if by_text:
        parts.append(distinct_from(table, text_values(table, by_text)))
    if not parts:
        return table.empty("slot int, uniques bigint, top bigint")
    return reduce(DataFrame.unionByName, parts)


def lexical_stats(table: Table, fields: list[Field]) -> DataFrame:
    """(groups, slot, uniques, top, dates, one count per lexical class) of text columns.

    The patterns run once per distinct value. A digest stands for a text that is neither a number nor
    a date, and is classed as text like the text it stands for.
    """
    dated = text_values(table, fields).withColumn("is_date", is_date_text(F.col("value")))
    classed = dated.withColumn("class", lexical_class(F.col("value"), F.col("is_date")))
    return aggregate(
        classed, [*table.groups, "slot"],
        [
            "count(1) as uniques",
            "max(cnt) as top",
            # More than the class "date": years and packed days are integers by shape.
            "sum(if(is_date, cnt, 0)) as dates",
            *[f"sum(if(class = '{c}', cnt, 0)) as n_{c}" for c in LEXICAL_CLASSES],
        ],
    )


def lexical_scan(table: Table, fields: list[Field]) -> DataFrame:
    """(groups, slot, dates, one count per lexical class): the patterns run once per cell, no value is exchanged."""
    if not fields:
        return table.empty("slot int, dates bigint, " + ", ".join(f"n_{c} bigint" for c in LEXICAL_CLASSES))
    dated = _cells(table, fields, [f.sql for f in fields], "cell as value").withColumn("is_date", is_date_text(F.col("value")))
    classed = dated.withColumn("class", lexical_class(F.col("value"), F.col("is_date")))
    return aggregate(
        classed, [*table.groups, "slot"],
        ["count_if(is_date) as dates", *[f"count_if(class = '{c}') as n_{c}" for c in LEXICAL_CLASSES]],
    )
