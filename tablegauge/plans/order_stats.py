"""Exact quantiles without gathering a column in one task.

``percentile`` keeps all distinct values of a column in one map on one task, and a window over a
column sorts it in one task. Here the frequencies are range-partitioned by (group, column, value),
which splits a large column, or a hot group, over many tasks, sorted within its range, and written
with the number of the block of consecutive rows it lies in. The count per block says in which
block each wanted rank lies; only those blocks are looked into, each on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from .staging import Staging
from .stats import aggregate
from .table import Table


# Rows per block, as a power of two; a range has at most 2^33 rows, numbered by Spark.
BLOCK_BITS = 14
_RANGE_BITS = 33 - BLOCK_BITS


def write_ranges(table: Table, values: DataFrame, order: str, staging: Staging, name: str) -> DataFrame:
    """``values`` range-partitioned and sorted by (groups, slot, order), with the number of the block.

    The row number of a sorted partition, without its last bits, numbers the blocks in order.

    It must be a written table: the range limits come from a sample, so a second computation
    could cut the ranges elsewhere.
    """
    keys = [*table.groups, "slot", order]
    ranged = values.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staging.write(ranged.selectExpr("*", f"shiftright(monotonically_increasing_id(), {BLOCK_BITS}) as block"), name)


def block_index(table: Table, ranges: DataFrame, order: str) -> DataFrame:
    """(groups, slot, block, part, inside, low, high): a row per block of each column; part is its range."""
    blocks = aggregate(
        ranges, [*table.groups, "slot", "block"], ["sum(cnt) as inside", f"min({order}) as low", f"max({order}) as high"]
    )
    return blocks.selectExpr("*", f"shiftright(block, {_RANGE_BITS}) as part")


def range_index(table: Table, index: DataFrame) -> DataFrame:
    """(groups, slot, part, inside, low, high): a row per range of each column, so as many as tasks at most."""
    return aggregate(
        index, [*table.groups, "slot", "part"], ["sum(inside) as inside", "min(low) as low", "max(high) as high"]
    )


Pin = Callable[[DataFrame], DataFrame]


def order_statistics(
    table: Table, ranges: DataFrame, index: DataFrame, parts: DataFrame, order: str, shares: Sequence[float], pin: Pin
) -> DataFrame:
    """(groups, slot, n, at_0, at_1, ...): linearly interpolated quantiles of ``order``.

    The sums before each range, of which there are as many as tasks, say in which ranges the wanted ranks
    lie; within those, the sums before each block say in which blocks. No window is over a whole column.
    ``pin`` may compute the blocks of those few ranges once.
    """
    keys = [*table.groups, "slot"]
    by = ", ".join(keys)
    # Both neighbours of each wanted position, as ranks from 0; kept where the rank is in the range or block.
    ranks = []
    for share in shares:
        below = f"cast(floor((n - 1) * {share}D) as bigint)"
        ranks += [below, f"least({below} + 1, n - 1)"]
    wanted = [f"t{w}" for w in range(len(ranks))]

    def holding(units: DataFrame, ranks: Sequence[str], *shown: str) -> DataFrame:
        inside = [f"if({r} >= before and {r} < before + inside, {r}, null) as {t}" for r, t in zip(ranks, wanted)]
        return units.selectExpr(*shown, "n", "before", *inside).where(f"coalesce({', '.join(wanted)}) is not null")

    summed = parts.selectExpr(
        *keys, "part", "inside", f"sum(inside) over (partition by {by}) as n",
        f"sum(inside) over (partition by {by} order by part rows unbounded preceding) - inside as before",
    )
    found = holding(summed, ranks, *keys, "part").withColumnRenamed("before", "before_part")
    opened = pin(table.attach(index.select(*keys, "part", "block", "inside"), found, "slot", "part"))
    blocks = opened.selectExpr(
        *keys, "block", "n", "inside", *wanted,
        f"before_part + sum(inside) over (partition by {by}, part order by block rows unbounded preceding) - inside as before",
    )
    located = holding(blocks, wanted, *keys, "block")

    hit = table.attach(ranges.select(*keys, "block", order, "cnt"), located, "slot", "block")
    ordered = hit.selectExpr(
        *keys, "n", *wanted, order, "cnt",
        f"before + sum(cnt) over (partition by {by}, block order by {order} rows unbounded preceding) as upto",
    )
    picks = [
        f"max(if({t} < upto and {t} >= upto - cnt, {order}, null)) as v{w}" for w, t in enumerate(wanted)
    ]
    picked = aggregate(ordered, keys, ["max(n) as n", *picks])
    quantiles = []
    for i, share in enumerate(shares):
        low, high = f"v{2 * i}", f"v{2 * i + 1}"
        rest = f"((n - 1) * {share}D - floor((n - 1) * {share}D))"
        # A rank without a fraction is a value, also where the next one is infinite.
        quantiles.append(f"if({low} = {high} or {rest} = 0, {low}, {low} + ({high} - {low}) * {rest}) as at_{i}")
    return picked.selectExpr(*keys, "n", *quantiles)


def median_distance(
    table: Table, ranges: DataFrame, index: DataFrame, parts: DataFrame, order: str, centre: DataFrame, pin: Pin
) -> DataFrame:
    """(groups, slot, mad): the median distance of ``order`` from ``median``; ``centre`` is (groups, slot, n, median).

    Left and right of the median the sorted values are two runs sorted by distance, so nothing is sorted
    again. A range, and then a block, has a least and a largest distance. Adding up the units by their
    largest distance bounds the wanted one from above, adding them up by their least from below. Units
    below both bounds are only counted, those above are dropped, and the few others are looked into.
    """
    keys = [*table.groups, "slot"]
    by = ", ".join(keys)
    infinite = "abs(median) = double('Infinity')"

    def narrowed(units: DataFrame, *shown: str) -> DataFrame:
        """The units that may hold the ranks k0 and k1, which are counted without the units below."""
        least = "if(low > median, low - median, if(high < median, median - high, 0D)) as least"
        most = "greatest(abs(low - median), abs(high - median)) as most"
        summed = units.selectExpr("*", least, most).selectExpr(
            "*",
            f"sum(inside) over (partition by {by} order by most rows unbounded preceding) as up_to_most",
            f"sum(inside) over (partition by {by} order by least rows unbounded preceding) - inside as before_least",
        )
        bounds = summed.selectExpr(
            "*",
            f"min(if(up_to_most > k1, most, null)) over (partition by {by}) as ceiling",
            f"max(if(before_least <= k0, least, null)) over (partition by {by}) as base",
        )
        below = f"sum(if(most < base, inside, 0)) over (partition by {by})"
        counted = bounds.selectExpr(*shown, "least", "most", "ceiling", "base", f"k0 - {below} as k0", f"k1 - {below} as k1")
        return counted.where("most >= base and least <= ceiling").select(*shown, "k0", "k1")

    finite = centre.where(f"not {infinite}").selectExpr(
        *keys, "median", "cast(floor((n - 1) * 0.5D) as bigint) as k0", "cast(ceil((n - 1) * 0.5D) as bigint) as k1",
    )
    found = narrowed(table.attach(parts, finite, "slot"), *keys, "part", "median")
    opened = pin(table.attach(index.select(*keys, "part", "block", "inside", "low", "high"), found, "slot", "part"))
    blocks = narrowed(opened, *keys, "block", "median")
    hit = table.attach(ranges.select(*keys, "block", order, "cnt"), blocks, "slot", "block")
    ordered = hit.selectExpr(*keys, "k0", "k1", "cnt", f"abs({order} - median) as distance").selectExpr(
        "*", f"sum(cnt) over (partition by {by} order by distance rows unbounded preceding) as upto",
    )
    picks = [f"max(if({k} < upto and {k} >= upto - cnt, distance, null)) as d{k[1]}" for k in ("k0", "k1")]
    near = aggregate(ordered, keys, picks).selectExpr(*keys, "if(d0 = d1, d0, d0 + (d1 - d0) * 0.5D) as mad")
    # From an infinite median every other value is infinitely far; equal ones have no distance.
    whole = aggregate(parts, keys, ["min(low) as low", "max(high) as high"])
    far = table.attach(whole, centre.where(infinite), "slot").where("low <> median or high <> median").selectExpr(
        *keys, "double('Infinity') as mad"
    )
    return near.unionByName(far)
