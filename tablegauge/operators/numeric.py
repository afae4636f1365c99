"""Numeric statistics: quantiles, outliers, shape, correlation, histograms, boxplots."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.expressions import finite_sql, rounded_sql
from ..plans.profile import KURTOSIS, SKEWNESS, Profile
from ..plans.stats import aggregate
from .structure import named, named_pairs

BOX = ("min", "q1", "median", "q3", "max", "whisker_low", "whisker_high")


def iqr_bounds(source, **options) -> DataFrame:
    """(position, column, q1, q3, lower, upper): quartiles and fences."""
    p = Profile.of(source, **options)
    return named(p, p.quartiles(), *rounded_sql("q1", "q3", "lower", "upper"))


def outliers(source, method: str = "iqr", **options) -> DataFrame:
    """(position, column, outliers): values outside the fences, or far from the median ("mad").

    Any method other than "mad" means the fences.
    """
    p = Profile.of(source, **options)
    count = "outliers_mad" if method == "mad" else "outliers_iqr"
    return named(p, p.facts(count, fields=p.table.numeric), f"{count} as outliers")


def outliers_iqr(source, **options) -> DataFrame:
    return outliers(source, "iqr", **options)


def outliers_mad(source, **options) -> DataFrame:
    return outliers(source, "mad", **options)


def distribution_shape(source, **options) -> DataFrame:
    """(position, column, skewness, kurtosis) with three decimals, of three values or more."""
    p = Profile.of(source, **options)
    shaped = p.flagged("shaped", "low", "high", "skew", "kurt", fields=p.table.numeric)
    return named(p, shaped, f"{SKEWNESS} as skewness", f"{KURTOSIS} as kurtosis")


def correlation_square(p: Profile) -> DataFrame:
    """(groups, slot_a, slot_b, corr): every ordered pair of numeric columns, 0 where undefined."""
    if len(p.table.numeric) < 2:
        return p.table.empty("slot_a int, slot_b int, corr double")
    groups = p.table.groups
    both = p.correlations().selectExpr(
        *groups,
        "inline(array(struct(slot_a, slot_b, value), struct(slot_b as slot_a, slot_a as slot_b, value)))",
    )
    diagonal = p.facts("low", "high", fields=p.table.numeric).selectExpr(
        *groups, "slot as slot_a", "slot as slot_b", "if(low < high, 1D, 0D) as value"
    )
    # Adding zero turns -0.0 into 0.0.
    corr = f"round(coalesce({finite_sql('value')}, 0D), 3) + 0D as corr"
    return both.unionByName(diagonal).selectExpr(*groups, "slot_a", "slot_b", corr)


def correlation_matrix(source, **options) -> DataFrame:
    """(column_a, column_b, corr): every ordered pair of numeric columns, three decimals."""
    p = Profile.of(source, **options)
    return named_pairs(p, correlation_square(p), "corr")


def correlated(p: Profile) -> DataFrame:
    """(groups, slot_a, slot_b, strength): pairs whose unrounded |r| reaches the threshold."""
    strength = f"abs({finite_sql('value')})"
    return p.correlations().where(f"{strength} >= {p.thresholds.correlation}D").selectExpr(
        *p.table.groups, "slot_a", "slot_b", f"round({strength}, 3) as strength"
    )


def correlated_columns(source, **options) -> DataFrame:
    """(column_a, column_b, strength): strongly correlated pairs, without the sign."""
    p = Profile.of(source, **options)
    return named_pairs(p, correlated(p), "strength")


def histogram_bins(p: Profile, bins: int) -> DataFrame:
    """(groups, slot, bin, lower, upper, count): every bin of every column that varies."""
    # Bins need no frequencies: unless those are there, the cells are counted per bin in each task.
    counted = p.value_counts() if p.gathered else p.cells()
    ends = p.facts("first_edge", "last_edge", fields=p.table.numeric).where("first_edge < last_edge").selectExpr(
        "*", f"(last_edge - first_edge) / {bins} as step"
    )
    placed = p.table.attach(counted.where("abs(value) < double('Infinity')"), ends, "slot").selectExpr(
        *p.keys, "value", "cnt", "first_edge", "step",
        f"least(cast(floor((value - first_edge) / (last_edge - first_edge) * {bins}) as int), {bins - 1}) as guess",
    )
    # The division can land one bin off its edges; the edges decide.
    settled = (
        "case when value < first_edge + guess * step then guess "
        f"when guess < {bins - 1} and value >= first_edge + (guess + 1) * step then guess + 2 "
        "else guess + 1 end as bin"
    )
    filled = aggregate(placed.selectExpr(*p.keys, "cnt", settled), [*p.keys, "bin"], ["sum(cnt) as count"])
    every = ends.selectExpr("*", f"explode(sequence(1, {bins})) as bin")
    upper = f"if(bin = {bins}, last_edge, first_edge + bin * step)"
    return p.table.attach(every, filled, "slot", "bin", how="left").selectExpr(
        *p.keys, "bin", "round(first_edge + (bin - 1) * step, 3) as lower", f"round({upper}, 3) as upper",
        "coalesce(count, 0) as count",
    )


def histogram(source, bins: int | None = None, **options) -> DataFrame:
    """(position, column, bin, lower, upper, count): equal-width bins from 1, the last one closed."""
    p = Profile.of(source, **options)
    return named(p, histogram_bins(p, bins or p.thresholds.histogram_bins), "bin", "lower", "upper", "count")


def non_finite_values(source, **options) -> DataFrame:
    """(position, column, non_finite): infinite values of the numeric columns, which no histogram holds. NaN is missing."""
    p = Profile.of(source, **options)
    return named(p, p.facts("non_finite", fields=p.table.numeric), "non_finite")


def boxes(p: Profile) -> DataFrame:
    """(groups, slot, min, q1, median, q3, max, whisker_low, whisker_high) of columns with values."""
    needed = ("low", "q1", "median", "q3", "high", "whisker_low", "whisker_high")
    return p.facts("filled", *needed, fields=p.table.numeric).where("filled > 0").withColumnsRenamed(
        {"low": "min", "high": "max"}
    )


def boxplot_stats(source, **options) -> DataFrame:
    """(position, column, min, q1, median, q3, max, whisker_low, whisker_high)."""
    p = Profile.of(source, **options)
    return named(p, boxes(p), *rounded_sql(*BOX))


def boxplot_points(p: Profile, limit: int, order_by: str | None = None) -> DataFrame:
    """(groups, slot, nth, value): up to ``limit`` values outside the fences of each column.

    The farthest come first, then the larger ones. With ``order_by`` it is the first ones in the
    order of that column. Each task keeps its own first ``limit`` rows before the shuffle.
    """
    fences = p.quartiles().select(*p.keys, "lower", "upper")
    far = "value < lower or value > upper"
    by = ", ".join(p.keys)
    if order_by is None:
        beyond = p.table.attach(p.value_counts(), fences, "slot").where(far)
        # A repeated value fills several places, but never more than there are.
        points = beyond.selectExpr(
            *p.keys, "value", "greatest(lower - value, value - upper) as distance",
            f"explode(sequence(1, cast(least(cnt, {limit}) as int)))",
        )
        nth = f"row_number() over (partition by {by} order by distance desc, value desc) as nth"
    else:
        cells = ", ".join(f"struct({f.slot} as slot, {f.number} as value)" for f in p.table.numeric)
        raw = p.table.with_sort_key(order_by).selectExpr(*p.table.groups, "sort_key", f"inline(array({cells}))")
        points = p.table.attach(raw.where("value is not null"), fences, "slot").where(far)
        nth = f"row_number() over (partition by {by} order by sort_key, value) as nth"
    return points.selectExpr(*p.keys, "value", nth).where(f"nth <= {limit}")


def boxplot_outliers(source, limit: int | None = None, order_by: str | None = None, **options) -> DataFrame:
    """(position, column, nth, value): outlier points of a boxplot."""
    p = Profile.of(source, **options)
    points = boxplot_points(p, limit or p.thresholds.boxplot_points, order_by)
    return named(p, points, "nth", *rounded_sql("value"))


def negative_in_nonnegative(source, **options) -> DataFrame:
    """(position, column, negatives): columns named like a quantity with values below zero."""
    p = Profile.of(source, **options)
    return named(p, p.flagged("negative", fields=p.table.numeric), "negatives")


def chartable_columns(source, **options) -> DataFrame:
    """(position, column): numeric columns that are neither identifiers nor constant."""
    p = Profile.of(source, **options)
    needs, id_like = p.flags["id_like"]
    facts = p.facts(*needs, fields=p.table.numeric).where(f"uniques > 1 and not coalesce({id_like}, false)")
    return named(p, facts)
