"""Sketches: decisions that equal the exact ones, states that merge, and the lexical view of mixed types."""

import numpy as np
import pytest

from tablegauge import Profile
from tablegauge import operators as ops


@pytest.fixture(scope="module")
def df(spark):
    """Columns on either side of the lines of 0.9 (distinct) and 0.95 (top), a gapless run and one with a hole."""
    return spark.sql(
        "select id as run, if(id = 5, 90000, id) as hole, id % 18020 as code, id % 17980 as lot_id, "
        "if(id % 10000 < 9504, 'a', 'b' || id % 7) as near, if(id % 10000 < 9496, 'a', 'b') as far, "
        "cast(null as string) as gap, cast(id % 13 as double) / 4 as q from range(20000)"
    )


def same(operator, df, *columns, **options):
    exact, approx = (operator(df, mode=m, **options) for m in ("exact", "approx"))
    shown = columns or exact.columns
    assert sorted(exact.select(*shown).collect(), key=str) == sorted(approx.select(*shown).collect(), key=str)


def test_columns_near_a_line_are_counted(df):
    for operator in (ops.sequential_integers, ops.constant_columns, ops.near_constant_columns, ops.lexical_types):
        same(operator, df)
        same(operator, df.where("id < 0" if "id" in df.columns else "run < 0"))
    same(ops.high_cardinality, df, "column")
    same(ops.high_cardinality, df, "q", "column", group_cols=["q"])
    same(ops.near_constant_columns, df.where("near = 'b1' or gap is not null"), group_cols=["far"])


def test_no_frequencies_in_the_plan(df):
    with Profile(df, mode="approx") as p:
        p.gather()
        assert "ranges" not in p._known
        assert ops.health_score(p).first()["constant_columns"] == 3
    plan = ops.unique_counts(df, mode="approx")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(salt" in plan and "Generate posexplode" not in plan


def test_states_of_runs_merge(spark, df, tmp_path):
    for run, part in (("a", "run < 9000"), ("b", "run >= 9000"), ("b", "run >= 9000")):
        ops.write_profile(df.where(part).select("run", "q", "gap"), str(tmp_path), run)
    merged = {r["column"]: r for r in ops.merge_states(spark.read.parquet(f"{tmp_path}/states")).collect()}
    assert merged["run"].rows == 20000 and abs(merged["run"].distinct_values - 20000) <= 400
    assert abs(merged["run"]["median"] - 10000) <= 100 and merged["q"].distinct_values == 13
    assert (merged["gap"].filled, merged["gap"].distinct_values, merged["gap"]["median"]) == (0, 0, None)
    runs = ops.merge_states(spark.read.parquet(f"{tmp_path}/states"), ["run"])
    assert {(r["run"], r["rows"]) for r in runs.collect()} == {("a", 9000), ("b", 11000)}


def test_lexically_mixed(table):
    df = table(
        "a string, b string, c double, d string",
        a=["1", "2.5", "x", "7"], b=["p", "q", "r", "2"], c=[1.0, float("inf"), float("nan"), 3.0], d=["1", "2.5", None, ""],
    )
    assert ops.mixed_type_columns(df).collect() == []
    found = {r["column"]: r["types"] for r in ops.mixed_type_columns(df, mixed="lexical").collect()}
    assert found["a"] == found["b"] == 2 and "c" not in found
    assert ops.deduction(df.select("a", "b", "c"), "mixed_type_columns", mixed="lexical").first()["points"] == 5.0
    rules = [r["column_a"] for r in ops.findings(df.select("a", "c"), mixed="lexical").collect() if r["rule"] == "mixed_type"]
    assert rules == ["a"]
    with pytest.raises(ValueError):
        ops.mixed_type_columns(df, mixed="other")


def test_infinities(table):
    """They are counted beside a histogram, and do not spoil the quantiles below them."""
    df = table("v double, n int", v=[1.0, 3.0, float("inf"), float("nan")], n=[1, 2, 3, None])
    assert [tuple(r) for r in ops.non_finite_values(df).collect()] == [(0, "v", 1), (1, "n", 0)]
    for mode in ("exact", "approx"):
        assert ops.outliers_mad(df, mode=mode).where("column = 'v'").first()["outliers"] == 1
    assert ops.boxplot_stats(df).where("column = 'v'").first()["median"] == np.median([1, 3, np.inf])
    bars = ops.full_profile(df).first()["histogram_data"]
    assert bars["v"]["non_finite"] == 1 and sum(bars["v"]["counts"]) == 2
