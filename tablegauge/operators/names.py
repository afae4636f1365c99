"""What column names say. The names are data here, so a whole catalog can be searched at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..functions.expressions import id_name_sql, name_words_sql, target_name_sql
from ..plans.profile import Profile
from ..plans.table import quoted


def names_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, position, column, filled): the columns of many tables and their values."""
    parts = []
    for dataset, df in tables.items():
        p = Profile(df)
        parts.append(
            p.facts("filled").selectExpr(
                f"{quoted(dataset)} as dataset", "slot as position", f"{p.table.names()} as column", "filled"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def word_lists(columns: DataFrame, name: str = "column") -> DataFrame:
    """The columns table with one row per word of each name: (..., nth, word)."""
    return columns.selectExpr("*", f"posexplode({name_words_sql(f'`{name}`')}) as (nth, word)")


def target_names(columns: DataFrame, name: str = "column") -> DataFrame:
    """The rows whose name suggests the target of a model."""
    return columns.where(target_name_sql(f"`{name}`"))


def id_like_name(columns: DataFrame, name: str = "column") -> DataFrame:
    """The columns table with ``id_like``: whether a word of the name marks an identifier."""
    return columns.selectExpr("*", f"{id_name_sql(f'`{name}`')} as id_like")
