"""Pairs of columns: Pearson correlation and equality, as aggregates over whole rows.

A pair costs a few buffers in a partial aggregate, and no row is shuffled. Few pairs are aggregates in
generated code; the correlations of many come from cross-products of tiles (``gram``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame

from .gram import CORRELATION, UNCLEAR, cross_sums
from .stats import aggregate
from .table import Field, Table

CORRELATIONS_PER_SCAN = 6
FEW_CORRELATIONS = 24  # up to seven columns
EQUALITIES_PER_SCAN = 100
MARKS_PER_SCAN = 64

Pair = tuple[Field, Field]


def _per_pair(
    table: Table, pairs: list[Pair], size: int, build: Callable[[Field, Field], str], data_type: str
) -> DataFrame:
    if not pairs:
        return table.empty(f"slot_a int, slot_b int, value {data_type}")

    def scan(chunk: list[Pair]) -> DataFrame:
        wide = aggregate(table.df, table.groups, [f"{build(a, b)} as p{i}" for i, (a, b) in enumerate(chunk)])
        rows = ", ".join(
            f"struct({a.slot} as slot_a, {b.slot} as slot_b, p{i} as value)" for i, (a, b) in enumerate(chunk)
        )
        return wide.selectExpr(*table.groups, f"inline(array({rows}))")

    return reduce(DataFrame.unionByName, [scan(pairs[i : i + size]) for i in range(0, len(pairs), size)])


def _pearson(a: Field, b: Field) -> str:
    """Correlation over the rows where both are present; null where either does not vary there.

    ``corr`` divides by zero on a constant column; ``regr_r2`` does not, but loses the sign. Merged
    means can be off in the last digit, so the variance of a constant need not be zero: the ends
    decide whether a column varies.
    """
    varies = [f"min(if({y.sql} is null, null, {x.sql})) < max(if({y.sql} is null, null, {x.sql}))" for x, y in ((a, b), (b, a))]
    r = f"signum(covar_pop({a.number}, {b.number})) * sqrt(regr_r2({b.number}, {a.number}))"
    return f"if({' and '.join(varies)}, {r}, null)"


def correlations(table: Table, pin: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(groups, slot_a, slot_b, value) for numeric columns a < b.

    ``pin`` computes a small table once. Pairs whose sums lost their digits, or hold infinite values, are
    computed again one by one; the driver reads which, and the schema bounds them.
    """
    pairs = list(combinations(table.numeric, 2))
    if len(pairs) <= FEW_CORRELATIONS:
        return _per_pair(table, pairs, CORRELATIONS_PER_SCAN, _pearson, "double")
    sums = pin(cross_sums(table), "cross_sums")
    unclear = {(r["slot_a"], r["slot_b"]) for r in sums.where(UNCLEAR).select("slot_a", "slot_b").distinct().collect()}
    shown = [*table.groups, "slot_a", "slot_b"]
    if not unclear:
        return sums.selectExpr(*shown, f"{CORRELATION} as value")
    again = _per_pair(
        table, [(a, b) for a, b in pairs if (a.slot, b.slot) in unclear], CORRELATIONS_PER_SCAN, _pearson, "double",
    )
    listed = ", ".join(f"struct({a}, {b})" for a, b in sorted(unclear))
    clear = sums.where(f"struct(slot_a, slot_b) not in ({listed})").selectExpr(*shown, f"{CORRELATION} as value")
    return clear.unionByName(again)


def _equal(a: Field, b: Field) -> str:
    # Two columns of no rows are equal.
    return f"coalesce(bool_and({a.comparable} <=> {b.comparable}), true)"


def _sums_of(table: Table, df: DataFrame, fields: list[Field], size: int, sums: Callable[[Field], str]) -> DataFrame:
    """(groups, slot, filled, mark): a sum over the hashes of the cells per column.

    Unlike with an exclusive or, cells that occur an even number of times do not vanish from it. Of each
    hash 24 bits are added up, so that the sum cannot overflow below a trillion rows.
    """
    parts = []
    for i in range(0, len(fields), size):
        chunk = fields[i : i + size]
        wide = aggregate(
            df, table.groups, [x for f in chunk for x in (f"sum(shiftright({sums(f)}, 40)) as m{f.slot}", f"count({f.sql}) as n{f.slot}")],
        )
        rows = ", ".join(f"struct({f.slot} as slot, n{f.slot} as filled, m{f.slot} as mark)" for f in chunk)
        parts.append(wide.selectExpr(*table.groups, f"inline(array({rows}))"))
    return reduce(DataFrame.unionByName, parts)


def _alike(table: Table, marks: DataFrame) -> set[tuple[int, int]]:
    """Pairs of columns of one type with the same mark in some group. The schema bounds what the driver reads."""
    types = table.per_field([f.data_type.simpleString() for f in table.fields])
    same = aggregate(
        marks.selectExpr("*", f"{types} as type"), [*table.groups, "type", "filled", "mark"], ["sort_array(collect_list(slot)) as slots"]
    )
    found = same.where("size(slots) > 1").select("slots").distinct().collect()
    return {pair for row in found for pair in combinations(row["slots"], 2)}


def equal_pairs(table: Table) -> DataFrame:
    """(groups, slot_a, slot_b) of columns of one type with the same value in every row.

    First every column has a mark that does not depend on the order of rows, from hashes of its own
    cells, so each column is read once. Only columns that share one go on: with many such pairs, they
    are marked again, now together with a hash of their row, so that other orders differ. The pairs
    that are left are compared cell by cell.
    """
    by_slot = {f.slot: f for f in table.fields}
    several = [f for f in table.fields if sum(f.data_type == g.data_type for g in table.fields) > 1]
    alike = _alike(table, _sums_of(table, table.df, several, MARKS_PER_SCAN, lambda f: f"xxhash64({f.comparable})")) if several else set()
    if len(alike) > EQUALITIES_PER_SCAN:
        chosen = [by_slot[s] for s in sorted({s for pair in alike for s in pair})]
        row = f"xxhash64({', '.join(f.comparable for f in chosen)})"
        rows = table.df.selectExpr(*table.groups, *[f.sql for f in chosen], f"{row} as row_hash")
        alike &= _alike(table, _sums_of(table, rows, chosen, MARKS_PER_SCAN, lambda f: f"xxhash64(row_hash, {f.comparable})"))
    checked = _per_pair(table, [(by_slot[a], by_slot[b]) for a, b in sorted(alike)], EQUALITIES_PER_SCAN, _equal, "boolean")
    return checked.where("value").select(*table.groups, "slot_a", "slot_b")
