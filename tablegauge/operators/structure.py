"""Structure and completeness of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.expressions import PERCENTAGE
from ..plans.profile import Profile
from ..plans.sketches import approximate_distinct
from ..plans.stats import aggregate
from ..plans.table import INTEGRAL


def named(p: Profile, df: DataFrame, *expressions: str) -> DataFrame:
    """(groups, position, column, expressions...) from rows that carry a slot."""
    return p.table.present(df, "slot as position", f"{p.table.names()} as column", *expressions)


def named_pairs(p: Profile, df: DataFrame, *expressions: str) -> DataFrame:
    """(groups, column_a, column_b, expressions...) from rows that carry two slots."""
    names = [f"{p.table.names(f'slot_{x}')} as column_{x}" for x in "ab"]
    return p.table.present(df, *names, *expressions)


def shape(source, **options) -> DataFrame:
    """(rows, columns)."""
    p = Profile.of(source, **options)
    counted = p.duplicates() if p.gathered else aggregate(p.table.df, p.table.groups, ["count(1) as rows"])
    return p.table.present(counted, "rows", f"cast({len(p.table.fields)} as bigint) as columns")


def column_types(source, **options) -> DataFrame:
    """(position, column, type, filled): the schema and how many values each column holds."""
    p = Profile.of(source, **options)
    return named(p, p.facts("filled"), f"{p.table.types()} as type", "filled")


def missing_values(source, **options) -> DataFrame:
    """(position, column, missing)."""
    p = Profile.of(source, **options)
    return named(p, p.facts("missing"), "missing")


def missing_percentage(source, **options) -> DataFrame:
    """(position, column, percentage) with two decimals; no row for an empty table."""
    p = Profile.of(source, **options)
    return named(p, p.facts("missing", "rows").where("rows > 0"), f"{PERCENTAGE} as percentage")


def duplicate_rows(source, **options) -> DataFrame:
    """(duplicates): rows equal to another one, each set of equals counted once less."""
    p = Profile.of(source, **options)
    return p.table.present(p.duplicates(), "duplicates")


def unique_counts(source, **options) -> DataFrame:
    """(position, column, distinct_values), missing ones left out."""
    p = Profile.of(source, **options)
    if p.mode == "approx" and not p.gathered:
        counted = approximate_distinct(p.table, p.table.fields, top=False)
    else:
        counted = p.facts("uniques")
    return named(p, counted, "uniques as distinct_values")


def constant_columns(source, **options) -> DataFrame:
    """(position, column): at most one distinct value; a column without values counts."""
    p = Profile.of(source, **options)
    return named(p, p.flagged("constant"))


def near_constant_columns(source, **options) -> DataFrame:
    """(position, column, share): one value fills most of a column that is not constant."""
    p = Profile.of(source, **options)
    return named(p, p.flagged("near_constant"), "round(top / filled, 4) as share")


def duplicate_columns(source, **options) -> DataFrame:
    """(column_a, column_b): identical type, values and gaps."""
    p = Profile.of(source, **options)
    return named_pairs(p, p.equal_pairs())


def memory_usage(source, **options) -> DataFrame:
    """(position, column, kilobytes): logical size of the values."""
    p = Profile.of(source, **options)
    return named(p, p.facts("bytes"), "round(bytes / 1024, 2) as kilobytes")


def possible_target_columns(source, **options) -> DataFrame:
    """(position, column): columns whose name suggests the target of a model."""
    p = Profile.of(source, **options)
    return named(p, p.flagged("possible_target"))


def sequential_integers(source, **options) -> DataFrame:
    """(position, column, sequential) of the numeric columns: a gapless run of integers."""
    p = Profile.of(source, **options)
    needs, gapless = p.flags["gapless"]
    return named(p, p.facts(*needs, fields=p.table.numeric), f"{gapless} as sequential")


def high_cardinality(source, **options) -> DataFrame:
    """(position, column, distinct_values): nearly unique, and by name, type or run an identifier."""
    p = Profile.of(source, **options)
    return named(p, p.flagged("id_like"), "uniques as distinct_values")


def recommended_types(source, **options) -> DataFrame:
    """(position, column, type, recommended): the narrowest integer type that holds a column."""
    p = Profile.of(source, **options)
    integral = [f for f in p.table.fields if f.kind == INTEGRAL]
    fits = [
        f"when low_whole >= {-(1 << bits - 1)} and high_whole < {1 << bits - 1} then '{name}'"
        for bits, name in ((8, "tinyint"), (16, "smallint"), (32, "int"))
    ]
    narrowest = f"case {' '.join(fits)} else 'bigint' end as recommended"
    limits = p.facts("low_whole", "high_whole", fields=integral)
    return named(p, limits, f"{p.table.types()} as type", narrowest)
