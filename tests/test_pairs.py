"""Correlations of many columns, duplicate rows and identical columns against plain versions."""

import math
import time

import numpy as np
import pandas as pd
import pytest

from tablegauge import Profile
from tablegauge import operators as ops
from tablegauge.plans import gram, pairs
from tablegauge.plans.table import Table


@pytest.fixture(scope="module")
def wide(spark):
    """Columns of many sizes with gaps, constants, twins, offsets, overflow and infinity."""
    rng = np.random.default_rng(11)
    rows, columns = 400, 12
    x = rng.normal(size=(rows, columns)) * 10.0 ** rng.integers(-4, 5, columns) + rng.normal(size=columns) * 1e5
    x[rng.random((rows, columns)) < 0.15] = np.nan
    x[:, 1] = 7.1
    x[:, 2] = np.where(np.isnan(x[:, 0]), x[:, 2], 0.3)  # constant where column 0 is present
    x[:, 3] = x[:, 4] * -2
    x[:, 5] = np.nan
    x[:, 6] = np.where(np.isnan(x[:, 7]), 0, 1e9 + rng.normal(size=rows))  # far from its median there
    frame = pd.DataFrame(x, columns=[f"x{i}" for i in range(columns)])
    frame["g"] = rng.integers(0, 3, rows)
    return frame, spark.createDataFrame(frame).repartition(3)


def compare(found, frame):
    wanted = frame.corr()
    for (a, b), value in found.items():
        if a != b:
            expected = wanted.loc[a, b]
            assert value == pytest.approx(0.0 if math.isnan(expected) else expected, abs=6e-4), (a, b)
    assert len(found) == wanted.size


@pytest.mark.parametrize("tile", [gram.TILE, 5])
def test_correlations_of_many_columns(wide, monkeypatch, tile):
    monkeypatch.setattr(gram, "TILE", tile)
    frame, df = wide
    found = ops.correlation_matrix(df.drop("g")).collect()
    compare({(r.column_a, r.column_b): r.corr for r in found}, frame.drop(columns="g"))


def test_correlations_of_many_columns_by_group(wide):
    frame, df = wide
    found = ops.correlation_matrix(df, group_cols=["g"]).collect()
    for g, part in frame.groupby("g"):
        compare({(r.column_a, r.column_b): r.corr for r in found if r.g == g}, part.drop(columns="g"))


def test_infinite_and_huge_values(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(60, 9)), columns=[f"x{i}" for i in range(9)])
    frame.loc[3, "x0"], frame.loc[3, "x1"] = np.inf, np.nan
    frame["x2"] = frame["x3"] * 1e152
    found = {(r.column_a, r.column_b): r.corr for r in ops.correlation_matrix(spark.createDataFrame(frame)).collect()}
    assert found["x0", "x4"] == 0.0  # infinity meets a value
    assert found["x0", "x1"] == pytest.approx(frame[["x0", "x1"]].replace(np.inf, np.nan).corr().iloc[0, 1], abs=6e-4)
    assert found["x2", "x4"] == found["x3", "x4"] and found["x2", "x3"] == 1.0


def test_many_columns_take_few_scans(spark):
    frame = pd.DataFrame(np.random.default_rng(3).normal(size=(50, 200)), columns=[f"x{i}" for i in range(200)])
    df = spark.createDataFrame(frame)
    with Profile(df) as p:
        started = time.perf_counter()
        plan = gram.cross_sums(p.table)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and time.perf_counter() - started < 10
    strong = ops.correlated_columns(spark.createDataFrame(frame.assign(y=frame["x0"] * 3 + 1))).collect()
    assert [(r.column_a, r.column_b, r.strength) for r in strong] == [("x0", "y", 1.0)]


def test_marks_of_cells_that_occur_an_even_number_of_times(spark):
    """Copies of all rows leave columns as different as they were, so only likely twins are compared."""
    rows = spark.range(50).selectExpr("id as a", "id * 3 as b", "id as twin", "cast(id as string) as t", "cast(id + 1 as string) as u")
    copied = Table(rows.unionAll(rows))
    marks = pairs._sums_of(copied, copied.df, copied.fields, 64, lambda f: f"xxhash64({f.comparable})")
    assert pairs._alike(copied, marks) == {(0, 2)}
    assert [(r["column_a"], r["column_b"]) for r in ops.duplicate_columns(rows.unionAll(rows)).collect()] == [("a", "twin")]
