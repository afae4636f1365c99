"""Inputs that once gave wrong results or crashed."""

import pytest

from tablegauge import operators as ops


@pytest.fixture
def readings(table):
    values = [1.0, 2.0, 3.0, 2.0, 1.0, 90.0, 2.0, -80.0]
    days = [f"2024-03-{n:02d}" for n in range(1, 9)]
    return table("at bigint, site string, value double, day string", at=[8, 7, 6, 5, 4, 3, 2, 1], site=["n"] * 8, value=values, day=days)


def test_order_by_a_column_that_is_not_profiled(readings):
    found = ops.boxplot_outliers(readings, columns=["value"], order_by="at").collect()
    assert [(r.nth, r.value) for r in found] == [(1, -80.0), (2, 90.0)]
    grouped = ops.boxplot_outliers(readings, columns=["value"], group_cols=["site"], order_by="site").count()
    assert grouped == 2
    dated = ops.date_like_columns(readings, columns=["day"], sample_size=3, order_by="at").collect()
    assert [(r.column, r.share) for r in dated] == [("day", 1.0)]


def test_order_by_an_unknown_column(readings):
    with pytest.raises(ValueError, match="no such column"):
        ops.boxplot_outliers(readings, order_by="nowhere")
    with pytest.raises(ValueError, match="no such column"):
        ops.date_like_columns(readings, sample_size=3, order_by="nowhere")


def test_a_json_null_is_no_type(spark):
    mixed = spark.sql("select parse_json(j) as v, parse_json(k) as w from values ('1', '1'), ('2', '\"x\"'), ('null', 'null') as t(j, k)")
    assert [(r.column, r.types) for r in ops.mixed_type_columns(mixed).collect()] == [("w", 2)]


def test_a_gate_on_a_check_that_does_not_exist(readings, spark):
    with pytest.raises(ValueError, match="outlier_mad"):
        ops.quality_gate(readings, {"outlier_mad": ("max", 0), "rows": ("min", 1)})
    limits = spark.createDataFrame([("outlier_mad", "max", 0.0), ("rows", "min", 1.0)], "check string, bound string, limit double")
    found = {r.check: (r.actual, r.passed) for r in ops.quality_gate(readings, limits).collect()}
    assert found == {"outlier_mad": (None, False), "rows": (8.0, True)}


def test_many_columns_that_start_alike(spark):
    """Constant columns in front do not hide the order of rows behind them."""
    front = ", ".join(f"1 as a{n}" for n in range(10))
    wide = spark.sql(f"select {front}, id as x, 99 - id as y, id as z from range(100)")
    pairs = {(r.column_a, r.column_b) for r in ops.duplicate_columns(wide).collect()}
    assert pairs == {(f"a{i}", f"a{j}") for i in range(10) for j in range(i + 1, 10)} | {("x", "z")}
