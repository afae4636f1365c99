import numpy as np
import pandas as pd
import pytest

from tablegauge import Profile
from tablegauge import operators as ops


def by_column(df, value):
    return {r["column"]: r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame({
        "normal": rng.normal(0, 1, n).round(3),
        "heavy": np.concatenate([rng.exponential(5, n - 3), [1e9, -1e12, 5e300]]),
        "ints": rng.integers(-50, 50, n),
        "gaps": rng.normal(100, 5, n),
        "constant": np.full(n, 0.1),
    })
    pdf.loc[::7, "gaps"] = np.nan
    return pdf


def test_quantiles_and_outliers_match_pandas(spark, numbers):
    df = spark.createDataFrame(numbers)
    with Profile(df) as p:
        bounds = {r["column"]: r for r in ops.iqr_bounds(p).collect()}
        iqr, mad = by_column(ops.outliers_iqr(p), "outliers"), by_column(ops.outliers_mad(p), "outliers")
        box = {r["column"]: r for r in ops.boxplot_stats(p).collect()}
    for c in numbers.columns:
        s = numbers[c].dropna()
        q1, q3 = s.quantile([0.25, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert bounds[c]["q1"] == pytest.approx(q1, abs=6e-4) and bounds[c]["q3"] == pytest.approx(q3, abs=6e-4)
        assert iqr[c] == ((s < low) | (s > high)).sum()
        spread = (s - s.median()).abs().median()
        expected = 0 if spread == 0 else ((0.6745 * (s - s.median()) / spread).abs() > 3.5).sum()
        assert mad[c] == expected
        assert box[c]["median"] == pytest.approx(s.median(), abs=6e-4)
        inside = s[(s >= low) & (s <= high)]
        assert box[c]["whisker_high"] == pytest.approx(inside.max(), abs=6e-4)


def test_results_do_not_depend_on_partitions(spark, numbers):
    df = spark.createDataFrame(numbers)

    def results(parts):
        made = df.repartition(parts)
        return [
            sorted(map(str, op(made).collect()))
            for op in (ops.iqr_bounds, ops.outliers_mad, ops.histogram, ops.unique_counts, ops.boxplot_outliers)
        ]

    assert results(1) == results(7) == results(64)


def test_quantiles_across_many_blocks(spark):
    # More values than a block holds, in one column that dwarfs the others.
    df = spark.range(100_000).selectExpr("cast((id * 7919) % 100003 as double) as big", "id % 5 as small")
    pdf = df.toPandas()
    found = {r["column"]: r for r in ops.iqr_bounds(df).collect()}
    for c in pdf:
        assert found[c]["q1"] == round(pdf[c].quantile(0.25), 3) and found[c]["q3"] == round(pdf[c].quantile(0.75), 3)


def test_groups_with_a_null_key_and_a_hot_group(spark):
    df = spark.range(6000).selectExpr(
        "case when id % 3 = 0 then null when id % 50 = 1 then 'rare' else 'hot' end as k",
        "cast((id * 37) % 1009 as double) as v",
    )
    pdf = df.toPandas()
    found = {r["k"]: r for r in ops.iqr_bounds(df, group_cols=["k"]).collect()}
    counted = {r["k"]: r["outliers"] for r in ops.outliers_mad(df, group_cols=["k"]).collect()}
    assert set(found) == {None, "rare", "hot"} == set(counted)
    for k, part in pdf.groupby("k", dropna=False):
        key = None if pd.isna(k) else k
        assert found[key]["q1"] == pytest.approx(part["v"].quantile(0.25), abs=6e-4)


def test_approximate_mode_is_close(spark):
    df = spark.range(20_000).selectExpr("cast((id * 7919) % 20011 as double) as v")
    exact, near = ops.iqr_bounds(df).collect()[0], ops.iqr_bounds(df, mode="approx").collect()[0]
    assert near["q1"] == pytest.approx(exact["q1"], rel=0.02)
    assert by_column(ops.unique_counts(df, mode="approx"), "distinct_values")["v"] == pytest.approx(20_000, rel=0.1)
    assert ops.outliers_mad(df, mode="approx").collect()[0]["outliers"] == 0


def test_shape_matches_pandas(spark, numbers):
    df = spark.createDataFrame(numbers[["normal", "ints", "gaps", "constant"]])
    found = {r["column"]: r for r in ops.distribution_shape(df).collect()}
    for c in found:
        assert found[c]["skewness"] == pytest.approx(numbers[c].skew(), abs=1.1e-3)
        assert found[c]["kurtosis"] == pytest.approx(numbers[c].kurt(), abs=1.1e-3)
    assert found["constant"]["skewness"] == 0.0


def test_shape_of_few_values(table):
    df = table("two double, three double", two=[1.0, 2.0, None], three=[1.0, 2.0, 4.0])
    rows = ops.distribution_shape(df).collect()
    assert [(r["column"], r["kurtosis"]) for r in rows] == [("three", None)]


def test_correlations(table, spark, numbers):
    df = table(
        "a int, b int, c string, flat int, d double",
        a=[1, 2, 3, 4], b=[2, 4, 6, 8], c=list("xyxy"), flat=[1] * 4, d=[None, -2.0, -3.0, -4.0],
    )
    matrix = {(r["column_a"], r["column_b"]): r["corr"] for r in ops.correlation_matrix(df).collect()}
    assert matrix["a", "a"] == 1.0 and matrix["a", "b"] == 1.0 and matrix["flat", "flat"] == 0.0
    assert matrix["a", "flat"] == 0.0 and matrix["d", "a"] == -1.0 and len(matrix) == 16
    pairs = sorted((r["column_a"], r["column_b"], r["strength"]) for r in ops.correlated_columns(df).collect())
    assert pairs == [("a", "b", 1.0), ("a", "d", 1.0), ("b", "d", 1.0)]
    assert ops.correlation_matrix(table("a int, b string", a=[1, 2], b=["x", "y"])).collect() == []
    some = numbers[["normal", "ints", "gaps"]]
    found = {(r["column_a"], r["column_b"]): r["corr"] for r in ops.correlation_matrix(spark.createDataFrame(some)).collect()}
    for a in some:
        for b in some:
            assert found[a, b] == pytest.approx(some[a].corr(some[b]), abs=6e-4)


def test_constants_correlate_with_nothing_however_they_are_merged(spark):
    df = spark.range(0, 3001, 1, 7).selectExpr(
        "1 as one", "0.1D as tenth", "cast(id % 13 as double) as v",
        "if(id % 2 = 0, null, cast(id % 5 as double)) as odd", "if(id % 2 = 0, 0.3D, id * 1D) as flat_elsewhere",
        "if(id % 2 = 0, id, null) as even",
    )
    found = {(r["column_a"], r["column_b"]): r["corr"] for r in ops.correlation_matrix(df).collect()}
    assert all(r == 0.0 for (a, b), r in found.items() if {a, b} & {"one", "tenth"})
    assert found["flat_elsewhere", "even"] == 0.0 and found["v", "v"] == 1.0


def test_histogram(table, spark, numbers):
    rows = ops.histogram(table("a int, flat int", a=list(range(100)), flat=[5] * 100), bins=5).collect()
    assert [r["count"] for r in sorted(rows, key=lambda r: r["bin"])] == [20] * 5
    assert {r["column"] for r in rows} == {"a"}
    found = ops.histogram(spark.createDataFrame(numbers[["normal", "gaps", "ints"]])).collect()
    for c in ("normal", "gaps", "ints"):
        counts, edges = np.histogram(numbers[c].dropna(), bins=10)
        mine = sorted((r for r in found if r["column"] == c), key=lambda r: r["bin"])
        assert [r["count"] for r in mine] == counts.tolist()
        assert [r["lower"] for r in mine] == pytest.approx(edges[:-1].tolist(), abs=6e-4)


def test_infinity_is_a_value_but_no_part_of_a_histogram(table):
    df = table("a double", a=[1.0, 2.0, 3.0, float("inf"), float("-inf")])
    assert sum(r["count"] for r in ops.histogram(df).collect()) == 3
    assert ops.missing_values(df).collect()[0]["missing"] == 0
    assert ops.distribution_shape(df).collect()[0]["skewness"] is None


def test_boxplot(table):
    box = ops.boxplot_stats(table("a int, t string", a=list(range(1, 11)), t=["x"] * 10)).collect()
    assert len(box) == 1
    assert (box[0]["min"], box[0]["median"], box[0]["max"]) == (1.0, 5.5, 10.0)
    df = table("n int, a int", n=list(range(8)), a=[10, 12, 11, 1000, 12, 11, 10, 900])
    assert [r["value"] for r in ops.boxplot_outliers(df, columns=["a"]).orderBy("nth").collect()] == [1000.0, 900.0]
    first = ops.boxplot_outliers(df, order_by="n", limit=1).collect()
    assert [(r["column"], r["value"]) for r in first] == [("a", 1000.0)]


def test_repeated_outliers_fill_places(spark):
    df = spark.range(2000).selectExpr("if(id % 20 = 0, 500, id % 7) as a")
    rows = ops.boxplot_outliers(df).collect()
    assert [r["value"] for r in rows] == [500.0] * 50


def test_negative_and_chartable(table):
    n = 20
    df = table(
        "age int, page_id int, temperature int, name string",
        age=[10, -1] * 10, page_id=[-1] * n, temperature=[-5, 3] * 10, name=["a"] * n,
    )
    assert sorted(by_column(ops.negative_in_nonnegative(df), "negatives").items()) == [("age", 10), ("page_id", 20)]
    value = [10, 12, 11, 13, 14, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 100]
    df = table("id int, constant int, value int", id=list(range(1, 21)), constant=[1] * 20, value=value)
    assert [r["column"] for r in ops.chartable_columns(df).collect()] == ["value"]


def test_all_null_column_has_no_outliers(table):
    df = table("a double, b int", a=[None, None], b=[1, 2])
    assert by_column(ops.outliers_iqr(df), "outliers") == {"a": 0, "b": 0}
    assert by_column(ops.outliers_mad(df), "outliers") == {"a": 0, "b": 0}


def test_decimals(spark):
    df = spark.sql("select cast(id as decimal(20,2)) / 4 as d from range(100)")
    assert ops.iqr_bounds(df).collect()[0]["q1"] == 6.188
    assert ops.unique_counts(df).collect()[0]["distinct_values"] == 100
