"""The whole report: as long tables, as one nested row, as JSON."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import DEDUCTION_CAPS
from ..functions.expressions import PERCENTAGE, finite_sql
from ..plans.profile import FACTS, KURTOSIS, SKEWNESS, Profile
from ..plans.stats import aggregate
from . import numeric, score, structure, text
from .history import column_states
from .numeric import BOX


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column, also inside nested ones."""

    def safe(col: Column, data_type: T.DataType) -> Column:
        if isinstance(data_type, (T.DoubleType, T.FloatType)):
            return F.when(F.abs(col) < float("inf"), col)
        if isinstance(data_type, T.ArrayType):
            return F.transform(col, lambda x: safe(x, data_type.elementType))
        if isinstance(data_type, T.MapType):
            return F.transform_values(col, lambda _, v: safe(v, data_type.valueType))
        if isinstance(data_type, T.StructType):
            fields = [safe(col[f.name], f.dataType).alias(f.name) for f in data_type.fields]
            return F.when(col.isNotNull(), F.struct(*fields))
        return col

    return df.select(*[safe(df[f"`{f.name}`"], f.dataType).alias(f.name) for f in df.schema.fields])


def profile_tables(source, outlier_method: str = "mad", **options) -> dict[str, DataFrame]:
    """The sections of a report as long tables, all from one gathered profile."""
    p = Profile.of(source, **options).gather()
    return {
        "health_score": score.health_score(p),
        "score_breakdown": score.score_breakdown(p),
        "shape": structure.shape(p),
        "column_types": structure.column_types(p),
        "missing_values": structure.missing_values(p),
        "missing_percentage": structure.missing_percentage(p),
        "duplicates": structure.duplicate_rows(p),
        "unique_counts": structure.unique_counts(p),
        "constant_columns": structure.constant_columns(p),
        "near_constant_columns": structure.near_constant_columns(p),
        "possible_target_columns": structure.possible_target_columns(p),
        "high_cardinality_columns": structure.high_cardinality(p),
        "outliers_iqr": numeric.outliers_iqr(p),
        "outliers_mad": numeric.outliers_mad(p),
        "distribution_shape": numeric.distribution_shape(p),
        "duplicate_columns": structure.duplicate_columns(p),
        "correlated_columns": numeric.correlated_columns(p),
        "correlation_matrix": numeric.correlation_matrix(p),
        "histogram_data": numeric.histogram(p),
        "boxplot_stats": numeric.boxplot_stats(p),
        "boxplot_outliers": numeric.boxplot_outliers(p),
        "date_like_columns": text.date_like_columns(p),
        "mixed_type_columns": text.mixed_type_columns(p),
        "text_column_stats": text.text_column_stats(p),
        "memory_usage_kb": structure.memory_usage(p),
        "negative_in_nonnegative_columns": numeric.negative_in_nonnegative(p),
        "insights": score.findings(p, outlier_method),
    }


def write_profile(source, folder: str, run: str, outlier_method: str = "mad", **options) -> None:
    """Write every section under ``folder``, partitioned by run, so that runs add up to a history.

    ``states`` holds sketches of each column: ``merge_states`` puts runs together without their data.
    A run that is written again replaces its own rows and no others, also where a section has none now.
    """
    p = Profile.of(source, **options)
    escaped = p.table.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run)

    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{name}/run={escaped}")

    tables = profile_tables(p, outlier_method) | {"states": column_states(p)}
    with ThreadPoolExecutor(8) as pool:
        for written in [pool.submit(write, name, df) for name, df in tables.items()]:
            written.result()


def _sections(p: Profile) -> dict[str, str]:
    """The sections made from the columns of a group, in SQL over the sorted array ``cols``."""

    def mapped(value: str, keep: str = "true") -> str:
        kept = "cols" if keep == "true" else f"filter(cols, c -> {keep})"
        return f"map_from_entries(transform({kept}, c -> struct(c.name, {value})))"

    def names(flag: str) -> str:
        return f"transform(filter(cols, c -> c.{flag}), c -> c.name)"

    return {
        "column_types": mapped("c.type"),
        "missing_values": mapped("c.missing"),
        "missing_percentage": mapped("c.percentage", "c.rows > 0"),
        "unique_counts": mapped("c.uniques"),
        "constant_columns": names("constant"),
        "near_constant_columns": names("near_constant"),
        "possible_target_columns": names("possible_target"),
        "high_cardinality_columns": names("id_like"),
        "outliers_iqr": mapped("c.outliers_iqr", "c.is_numeric"),
        "outliers_mad": mapped("c.outliers_mad", "c.is_numeric"),
        "distribution_shape": mapped("struct(c.skewness, c.kurtosis)", "c.shaped"),
        "histogram_data": mapped(
            "struct(concat(transform(c.bars, b -> b.lower), array(element_at(c.bars, -1).upper)) as bin_edges, "
            "transform(c.bars, b -> b.count) as counts, c.non_finite)",
            "c.bars is not null",
        ),
        "boxplot_stats": mapped(
            f"struct({', '.join(f'c.{b}' for b in BOX)}, "
            "coalesce(transform(c.points, x -> x.value), cast(array() as array<double>)) as outliers)",
            "c.is_numeric and c.filled > 0",
        ),
        "date_like_columns": names("date_like"),
        "mixed_type_columns": names("mixed_type"),
        "text_column_stats": mapped(
            "struct(c.avg_length, c.min_length, c.max_length, c.blank as blank_or_whitespace_only)",
            "c.is_text and c.filled > 0",
        ),
        "memory_usage_kb": mapped("c.kilobytes"),
        "negative_in_nonnegative_columns": names("negative"),
    }


# The order of the report.
SECTIONS = (
    "health_score", "shape", "column_types", "missing_values", "missing_percentage", "duplicates",
    "unique_counts", "constant_columns", "near_constant_columns", "possible_target_columns",
    "high_cardinality_columns", "outliers_iqr", "outliers_mad", "distribution_shape",
    "duplicate_columns", "correlated_columns", "correlation_matrix", "histogram_data",
    "boxplot_stats", "date_like_columns", "mixed_type_columns", "text_column_stats",
    "memory_usage_kb", "negative_in_nonnegative_columns", "insights",
)


def full_profile(source, outlier_method: str = "mad", **options) -> DataFrame:
    """One row (per group) with the 25 sections of a report as nested columns.

    A section has an entry per column, pair or bin, so the schema bounds its size.
    """
    p = Profile.of(source, **options).gather()
    table, keys, groups = p.table, p.keys, p.table.groups

    bins = aggregate(
        numeric.histogram_bins(p, p.thresholds.histogram_bins), keys,
        ["sort_array(collect_list(struct(bin, lower, upper, count))) as bars"],
    )
    points = aggregate(
        numeric.boxplot_points(p, p.thresholds.boxplot_points), keys,
        [f"sort_array(collect_list(struct(nth, round({finite_sql('value')}, 3) as value))) as points"],
    )
    facts = table.attach(table.attach(p.facts(*FACTS), bins, "slot", how="left"), points, "slot", how="left")
    flags = [
        f"coalesce({sql}, false) as {flag}" for flag, (_, sql) in p.flags.items() if flag not in ("gapless", "skewed")
    ]
    boxes = [
        f"round({finite_sql(source)}, 3) as {b}"
        for b, source in zip(BOX, ("low", "q1", "median", "q3", "high", "whisker_low", "whisker_high"))
    ]
    shown = facts.selectExpr(
        *keys, f"{table.names()} as name", f"{table.types()} as type", "missing", "rows", "filled", "uniques",
        f"{PERCENTAGE} as percentage", "outliers_iqr", "outliers_mad", f"{SKEWNESS} as skewness",
        f"{KURTOSIS} as kurtosis", "bars", "points", *boxes, *flags, "round(avg_length, 1) as avg_length",
        "min_length", "max_length", "blank", "non_finite", "round(bytes / 1024, 2) as kilobytes",
        f"{table.among(table.numeric)} as is_numeric", f"{table.among(table.textual)} as is_text",
    )
    cell = ", ".join(c for c in shown.columns if c not in keys)
    cols = aggregate(shown, groups, [f"array_sort(collect_list(struct(slot, {cell})), {_BY_SLOT}) as cols"])

    def listed(df: DataFrame, entry: str, item: str, name: str) -> DataFrame:
        entries = aggregate(df, groups, [f"sort_array(collect_list(struct({entry}, {item} as item))) as e"])
        return entries.selectExpr(*groups, f"transform(e, x -> x.item) as {name}")

    pair = ", ".join(f"{table.names(f'slot_{x}')} as column_{x}" for x in "ab")
    matrix = aggregate(
        numeric.correlation_square(p), [*groups, "slot_a"],
        [f"sort_array(collect_list(struct(slot_b, {table.names('slot_b')} as name, corr))) as cells"],
    )
    square = aggregate(
        matrix, groups, [f"sort_array(collect_list(struct(slot_a, {table.names('slot_a')} as name, cells))) as e"]
    ).selectExpr(
        *groups,
        "map_from_entries(transform(e, x -> struct(x.name, map_from_entries("
        "transform(x.cells, y -> struct(y.name, y.corr)))))) as correlation_matrix",
    )
    parts = [
        cols,
        score.scored(p).selectExpr(
            *groups, f"struct(score, grade, struct({', '.join(DEDUCTION_CAPS)}) as breakdown) as health_score"
        ),
        listed(p.equal_pairs(), "slot_a, slot_b", f"struct({pair})", "duplicate_columns"),
        listed(numeric.correlated(p), "slot_a, slot_b", f"struct({pair}, strength)", "correlated_columns"),
        square,
        listed(score.found(p, outlier_method), "rule_no, slot_a, slot_b", "message", "insights"),
    ]
    report = p.duplicates().selectExpr(
        *groups, f"struct(rows, cast({len(table.fields)} as bigint) as columns) as shape", "duplicates"
    )
    for part in parts:
        report = table.attach(report, part, how="left")
    made = _sections(p)
    # Lists without an entry are empty, not missing.
    lists = {
        "duplicate_columns": "array<struct<column_a:string,column_b:string>>",
        "correlated_columns": "array<struct<column_a:string,column_b:string,strength:double>>",
        "correlation_matrix": "map<string,map<string,double>>",
        "insights": "array<string>",
    }
    for name, data_type in lists.items():
        nothing = "map()" if data_type.startswith("map") else "array()"
        made[name] = f"coalesce({name}, cast({nothing} as {data_type}))"
    return table.present(report, *[f"{made.get(s, s)} as {s}" for s in SECTIONS])


# Maps and nested rows cannot be compared, so columns are sorted by their number alone.
_BY_SLOT = "(l, r) -> l.slot - r.slot"


def report_json(source, outlier_method: str = "mad", **options) -> DataFrame:
    """(report): the full profile as one JSON document per group, without NaN or infinity."""
    p = Profile.of(source, **options)
    report = json_safe(full_profile(p, outlier_method))
    body = F.struct(*SECTIONS)
    return report.select(*p.table.group_cols, F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))
