"""States of columns that can be stored per run and merged later, without the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..plans.profile import QUARTILES, Profile
from ..plans.sketches import DISTINCT, column_sketches, merged_values, quantile_sql, value_states
from ..plans.stats import aggregate
from .structure import named


def column_states(source, **options) -> DataFrame:
    """(position, column, rows, filled, distinct_state, value_state): sketches of the values of each column.

    ``value_state`` is null for columns that are not numeric or have no values.
    """
    p = Profile.of(source, **options)
    counted = column_sketches(p.table, p.table.fields, top=False)
    values = value_states(p.table, p.cells(), "value").select(*p.keys, "sketch")
    states = p.table.attach(counted, values, "slot", how="left")
    return named(p, states, "rows", "filled", "distinct_state", "sketch as value_state")


def merge_states(states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, rows, filled, distinct_values, q1, median, q3) of the runs or groups put together.

    ``keys`` are columns of ``states`` to keep apart, such as the month of a run.
    """
    by = [*keys, "column"]
    counted = aggregate(states, by, [
        "sum(rows) as rows", "sum(filled) as filled", "hll_union_agg(distinct_state) as distinct_state",
    ]).selectExpr(*[f"`{k}`" for k in by], "rows", "filled", f"coalesce({DISTINCT}, 0L) as distinct_values")
    numeric = states.where("value_state is not null").selectExpr(*[f"`{k}`" for k in by], "value_state as sketch", "filled as n")
    found = merged_values(numeric, by).selectExpr(*[f"`{k}` as k{i}" for i, k in enumerate(by)], *quantile_sql(QUARTILES))
    # A null key is a key like any other.
    same = [counted[k].eqNullSafe(found[f"k{i}"]) for i, k in enumerate(by)]
    return counted.join(found, same, "left").selectExpr(
        *[f"`{k}`" for k in by], "rows", "filled", "distinct_values", "at_0 as q1", "at_1 as median", "at_2 as q3"
    )
