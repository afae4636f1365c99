"""Duplicate rows: one aggregate over fingerprints; whole rows travel only where fingerprints disagree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import aggregate
from .table import Table

GAPS = 60


def duplicate_rows(table: Table, pin: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(groups, rows, duplicates): rows equal to another one of their group, less one per set of equals.

    A row is its 64-bit key, with another 64-bit hash as its check. One aggregate counts the rows of a
    key and keeps the ends of their checks, so copies leave a task as one row of four numbers. Where all
    checks of a key agree, its rows are equal. A key whose checks differ belongs to different rows: only
    the rows of such keys, some ten thousand among a trillion, are read again and counted by their full
    values. ``pin`` computes a small table once: it says whether there are such keys.
    """
    keys = table.groups
    if not table.fields:
        return aggregate(table.df, keys, ["count(1) as rows", "cast(0 as bigint) as duplicates"])
    cells = [f.sql for f in table.fields]
    # Null is skipped by the hash: where cells are missing enters as numbers of up to 60 bits.
    gaps = [
        " + ".join(f"if({c} is null, {1 << n}L, 0L)" for n, c in enumerate(cells[i : i + GAPS])) for i in range(0, len(cells), GAPS)
    ]
    parts = ", ".join([*keys, *cells, *gaps])
    keyed = table.df.selectExpr(*keys, *[f"{f.comparable} as {f.sql}" for f in table.fields]).selectExpr(
        "*", f"xxhash64({parts}) as row_key"
    )
    # A leading value of its own makes the other hash take another course from the first cell on.
    marked = keyed.selectExpr(*keys, "row_key", f"xxhash64('check', {parts}) as check")
    counted = aggregate(
        marked, [*keys, "row_key"], ["count(1) as cnt", "min(check) as low", "max(check) as high"]
    ).selectExpr(*keys, "row_key", "cnt", "low = high as same")
    clear = pin(aggregate(counted, keys, [
        "coalesce(sum(cnt), 0) as rows", "coalesce(sum(if(same, cnt - 1, 0)), 0) as surplus",
        "count_if(not same and cnt > 1) as unclear",
    ]), "row_keys")
    # The driver reads one number; without such keys, nothing is read again.
    if clear.where("unclear > 0").isEmpty():
        return clear.selectExpr(*keys, "rows", "surplus as duplicates")

    # Few keys at any size, so they are broadcast.
    unclear = F.broadcast(counted.where("not same and cnt > 1").select("row_key").distinct())
    copies = aggregate(keyed.join(unclear, "row_key", "left_semi"), [*keys, *cells], ["count(1) as cnt"])
    again = aggregate(copies, keys, ["sum(cnt - 1) as further"])
    joined = table.attach(clear, again, how="left")
    return joined.selectExpr(*keys, "rows", "surplus + coalesce(further, 0) as duplicates")
