"""Approximate quantiles, distinct counts and top values: mergeable sketches.

All are merged in two steps, so that no task merges those of all tasks. The states of distinct counts
and quantiles can be stored and merged later, for figures of many runs without their data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import aggregate
from .table import INTEGRAL, Field, Table

# Rank error of a sketch of this size is about 0.1 %.
SKETCH_SIZE = 4096
# 2^16 registers: the relative standard error of a distinct count is 0.4 %; small counts are exact.
DISTINCT_BITS = 16
# Values tracked for the most frequent one; its count is off by 0.35 % of the rows at most.
TRACKED = 1024
FIRST_MERGE = 256
COLUMNS_PER_SCAN = 16

# Decisions this near their line (five standard errors, and twice the most) are not left to a sketch.
NEAR_DISTINCT = 0.02
NEAR_TOP = 0.01


def _salted(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", f"spark_partition_id() % {FIRST_MERGE} as salt")


def value_states(table: Table, cells: DataFrame, order: str) -> DataFrame:
    """(groups, slot, sketch, n) of the values of cells."""
    keys = [*table.groups, "slot"]
    partial = aggregate(
        _salted(cells), [*keys, "salt"],
        [f"kll_sketch_agg_double({order}, {SKETCH_SIZE}) as sketch", f"count({order}) as n"],
    )
    return merged_values(partial, keys)


def merged_values(states: DataFrame, keys: list[str]) -> DataFrame:
    return aggregate(states, keys, [f"kll_merge_agg_double(sketch, {SKETCH_SIZE}) as sketch", "sum(n) as n"])


def quantile_sql(shares: Sequence[float], sketch: str = "sketch") -> list[str]:
    return [f"kll_sketch_get_quantile_double({sketch}, {s}D) as at_{i}" for i, s in enumerate(shares)]


def approximate_order_statistics(table: Table, cells: DataFrame, order: str, shares: Sequence[float]) -> DataFrame:
    """(groups, slot, n, at_0, at_1, ...) like the exact form, from one scan without a full shuffle."""
    return value_states(table, cells, order).selectExpr(*table.groups, "slot", "n", *quantile_sql(shares))


def column_sketches(table: Table, fields: list[Field], top: bool = True) -> DataFrame:
    """(groups, slot, rows, filled, low, high, distinct_state, top): a row per column and group.

    Values are sketched by a 64-bit hash, so a sketch holds no text. ``low`` and ``high`` are those of
    integers; ``top`` is null unless asked for, and 0 where no value fills 0.35 % of the rows.
    """
    keys = table.groups
    if not fields:
        return table.empty("slot int, rows bigint, filled bigint, low bigint, high bigint, distinct_state binary, top bigint")
    made = []
    for first in range(0, len(fields), COLUMNS_PER_SCAN):
        chunk = fields[first : first + COLUMNS_PER_SCAN]
        partial, merged, rows = ["count(1) as rows"], ["sum(rows) as rows"], []
        for f in chunk:
            n, there = f.slot, f"filter (where {f.sql} is not null)"
            partial += [
                f"count({f.sql}) as n{n}", f"hll_sketch_agg(xxhash64({f.comparable}), {DISTINCT_BITS}) {there} as d{n}",
            ]
            merged += [f"sum(n{n}) as n{n}", f"hll_union_agg(d{n}) as d{n}"]
            if f.kind == INTEGRAL:
                partial += [f"cast(min({f.sql}) as bigint) as low{n}", f"cast(max({f.sql}) as bigint) as high{n}"]
                merged += [f"min(low{n}) as low{n}", f"max(high{n}) as high{n}"]
            if top:
                partial.append(f"approx_top_k_accumulate(xxhash64({f.comparable}), {TRACKED}) {there} as t{n}")
                merged.append(f"approx_top_k_combine(t{n}, {TRACKED}) as t{n}")
            ends = [f"{e}{n} as {e}" if f.kind == INTEGRAL else f"cast(null as bigint) as {e}" for e in ("low", "high")]
            most = f"coalesce(get(approx_top_k_estimate(t{n}, 1), 0).count, 0L)" if top else "cast(null as bigint)"
            counts = f"coalesce(rows, 0L) as rows, coalesce(n{n}, 0L) as filled"
            rows.append(f"struct({n} as slot, {counts}, {', '.join(ends)}, d{n} as distinct_state, {most} as top)")
        scanned = aggregate(_salted(table.df), [*keys, "salt"], partial)
        if keys:
            found = aggregate(scanned, keys, merged)
        else:  # top values cannot be combined from no rows, but an empty table has figures as well
            whole = aggregate(scanned.selectExpr("*", "0 as every"), ["every"], merged)
            found = table.spark.range(1).selectExpr("0 as every").join(F.broadcast(whole), "every", "left")
        made.append(found.selectExpr(*keys, f"inline(array({', '.join(rows)}))"))
    return reduce(DataFrame.unionByName, made)


# A sketch of few values counts them exactly; no column has more distinct values than values.
DISTINCT = "least(hll_sketch_estimate(distinct_state), filled)"


def approximate_distinct(table: Table, fields: list[Field], top: bool = True) -> DataFrame:
    """(groups, slot, rows, filled, low, high, uniques, top)."""
    if not fields:
        return table.empty("slot int, rows bigint, filled bigint, low bigint, high bigint, uniques bigint, top bigint")
    sketched = column_sketches(table, fields, top)
    return sketched.selectExpr(
        *table.groups, "slot", "rows", "filled", "low", "high", f"coalesce({DISTINCT}, 0L) as uniques", "least(top, filled) as top"
    )


def undecided_sql(high_cardinality: float, min_unique: int, near_constant: float) -> str:
    """Whether a column's estimates lie so near a detector's line that only exact counts decide."""
    return (
        f"abs(uniques / nullif(rows, 0) - {high_cardinality}D) <= {NEAR_DISTINCT} "
        f"or abs(top / nullif(filled, 0) - {near_constant}D) <= {NEAR_TOP} "
        f"or uniques > 1000 and abs(uniques / {min_unique}D - 1) <= {NEAR_DISTINCT} "
        # A gapless run is as long as its range, and has no value twice.
        "or cast(high as decimal(38,0)) - cast(low as decimal(38,0)) + 1 = filled "
        f"and uniques >= {1 - NEAR_DISTINCT} * filled"
    )
