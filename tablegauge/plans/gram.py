"""Correlations of many columns from masked cross-products of column tiles.

A task keeps, for every pair of columns, six sums over the rows where both are present, as products of
matrices of Arrow batches. All tasks take the same value out of the table as origin of a column, so
the sums of tasks and groups just add up. One scan covers a tile pair of up to 256 x 256 columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .stats import aggregate
from .table import Field, Table

TILE = 256
SAMPLE = 1000
# Below this share of the sum of squares a variance has lost too many digits.
LEAST_VARIANCE = 1e-8
HUGE = 1e150

SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")
_SCHEMA = "slot_a int, slot_b int, " + ", ".join(f"{s} double" for s in SUMS)


def _products(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """n, sa, sb, saa, sbb, sab of columns of ``a`` against columns of ``b``; missing cells are NaN."""
    masks = [(~np.isnan(x)).astype(np.float64) for x in (a, b)]
    x, y = (np.nan_to_num(v, nan=0.0) for v in (a, b))
    ma, mb = masks
    return [ma.T @ mb, x.T @ mb, ma.T @ y, (x * x).T @ mb, ma.T @ (y * y), x.T @ y]


def _columns(batch: pa.RecordBatch, names: list[str], origins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns around their origins, NaN where missing; infinite cells; columns whose squares overflow."""
    values = [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]
    matrix = np.column_stack(values) - origins
    infinite = np.isinf(matrix)
    with np.errstate(invalid="ignore"):
        huge = np.abs(matrix) > HUGE
    if huge.any():
        matrix[huge] = 0.0
    return matrix, infinite, (huge & ~infinite).any(axis=0)


def _sums(left: list[tuple[int, str, float]], right: list[tuple[int, str, float]]):
    """Partial sums of the pairs of two tiles, per task, or per batch and group where there are groups."""
    slots = [np.array([slot for slot, *_ in side], np.int32) for side in (left, right)]
    origins = [np.array([origin for *_, origin in side]) for side in (left, right)]
    names = [[name for _, name, _ in side] for side in (left, right)]
    wanted = slots[0][:, None] < slots[1][None, :]
    pair_a, pair_b = (np.broadcast_to(s, wanted.shape)[wanted] for s in (slots[0][:, None], slots[1][None, :]))

    def rows(parts: list[list[np.ndarray]], keys: pa.Array | None) -> pa.RecordBatch:
        cells = [np.concatenate([p[i][wanted] for p in parts]) for i in range(len(SUMS))]
        columns = [pa.array(np.tile(p, len(parts)), pa.int32()) for p in (pair_a, pair_b)]
        columns += [pa.array(c) for c in cells]
        found = ["slot_a", "slot_b", *SUMS]
        if keys is not None:
            columns.insert(0, keys.take(pa.array(np.repeat(np.arange(len(parts)), len(pair_a)))))
            found.insert(0, "g")
        return pa.RecordBatch.from_arrays(columns, names=found)

    def products(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        (a, infinite_a, huge_a), (b, infinite_b, huge_b) = (_columns(batch, n, o) for n, o in zip(names, origins))
        huge = huge_a[:, None] | huge_b[None, :]
        if "key" not in batch.schema.names:
            groups = [(0, slice(None))]
        else:
            codes = np.asarray(batch.column("key").dictionary_encode().indices)
            order = np.argsort(codes, kind="stable")
            a, b, infinite_a, infinite_b = a[order], b[order], infinite_a[order], infinite_b[order]
            edges = np.append(np.flatnonzero(np.diff(codes[order], prepend=-1)), len(order))
            groups = [(order[s], slice(s, e)) for s, e in zip(edges[:-1], edges[1:])]
        for first, chosen in groups:
            x, y = a[chosen], b[chosen]
            made = _products(x, y)
            made[3][huge] = np.inf
            if infinite_a[chosen].any() or infinite_b[chosen].any():
                beside = [(~np.isnan(v)).astype(np.float64) for v in (x, y)]
                meets = infinite_a[chosen].T.astype(np.float64) @ beside[1] + beside[0].T @ infinite_b[chosen].astype(np.float64)
                made[3][meets > 0] = np.nan
            yield first, made

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            made = list(products(batch))
            if "key" in batch.schema.names:
                yield rows([m for _, m in made], batch.column("g").take(pa.array([int(f) for f, _ in made])))
            elif total is None:
                total = made[0][1]
            else:
                total = [t + m for t, m in zip(total, made[0][1])]
        if total is not None:
            yield rows([total], None)

    return sums


def _origins(table: Table, fields: list[Field]) -> dict[int, float]:
    """A value of each column: the median of the first rows, read by one small job."""
    medians = [f"percentile_approx(if(abs({f.number}) < double('Infinity'), {f.number}, null), 0.5D, 100) as o{f.slot}" for f in fields]
    row = table.df.limit(SAMPLE).selectExpr(*medians).first()
    return {f.slot: row[f"o{f.slot}"] or 0.0 for f in fields}


def cross_sums(table: Table) -> DataFrame:
    """(groups, slot_a, slot_b, n, sa, sb, saa, sbb, sab) of the numeric columns a < b.

    The sums are over the rows where both are present, around the columns' origins. ``saa`` is NaN where
    an infinite value is among them, and infinite where squares are too large.
    """
    fields, keys = table.numeric, table.groups
    origins = _origins(table, fields)
    tiles = [fields[i : i + TILE] for i in range(0, len(fields), TILE)]
    parts = None
    for left, right in combinations_with_replacement(tiles, 2):
        sides = [[(f.slot, f.sql, origins[f.slot]) for f in side] for side in (left, right)]
        columns = [f"{f.number} as {f.sql}" for f in dict.fromkeys([*left, *right])]
        grouped = ["g", "to_json(g) as key"] if keys else []
        schema = (f"g {table.df.schema['g'].dataType.simpleString()}, " if keys else "") + _SCHEMA
        part = table.df.selectExpr(*grouped, *columns).mapInArrow(_sums(*sides), schema)
        parts = part if parts is None else parts.unionAll(part)
    return aggregate(parts, [*keys, "slot_a", "slot_b"], [f"sum({s}) as {s}" for s in SUMS])


_SPREAD = {x: f"(s{x}{x} - s{x} * s{x} / nullif(n, 0D))" for x in "ab"}

# A correlation, null with infinite values, and where a column does not vary: all its values are its origin then.
CORRELATION = (
    "if(n > 0 and saa > 0 and sbb > 0 and not isnan(saa), "
    f"greatest(-1D, least(1D, (sab - sa * sb / nullif(n, 0D)) / (sqrt({_SPREAD['a']}) * sqrt({_SPREAD['b']})))), cast(null as double))"
)
# Whether the sums do not tell: too large squares, or nearly all digits of a variance lost.
UNCLEAR = "not isnan(saa) and (" + " or ".join(
    f"(s{x}{x} > 0 and not coalesce({_SPREAD[x]} > {LEAST_VARIANCE} * s{x}{x} and s{x}{x} < double('Infinity'), false))" for x in "ab"
) + ")"
