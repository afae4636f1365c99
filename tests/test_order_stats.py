"""Quantiles and median distances from blocks of sorted values, with blocks of every size."""

import numpy as np
import pandas as pd
import pytest

from tablegauge import Profile
from tablegauge import operators as ops
from tablegauge.plans import order_stats


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    n = 3000
    return pd.DataFrame({
        "normal": rng.normal(size=n), "few": rng.integers(0, 4, n) * 1.0, "steep": np.exp(rng.normal(size=n) * 5),
        "gaps": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n)), "run": np.arange(n) * 1.0,
        "one": np.full(n, 2.5), "none": np.full(n, np.nan), "far": np.where(rng.random(n) < 0.45, rng.normal(size=n), 1e9),
        "g": rng.integers(0, 3, n),
    })


@pytest.mark.parametrize("bits", [14, 6, 1])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_quantiles_and_distances(spark, frame, monkeypatch, bits, groups):
    monkeypatch.setattr(order_stats, "BLOCK_BITS", bits)
    monkeypatch.setattr(order_stats, "_RANGE_BITS", 33 - bits)
    columns = [c for c in frame if c != "g"]
    with Profile(spark.createDataFrame(frame).repartition(3), columns=columns, group_cols=groups) as p:
        quartiles = {(r["g"] if groups else None, r["slot"]): r for r in p.quartiles().collect()}
        distances = {(r["g"] if groups else None, r["slot"]): r for r in p.deviations().collect()}
        assert len(quartiles) == len(distances) == (len(columns) - 1) * (3 if groups else 1)
        for (g, slot), r in quartiles.items():
            x = frame[frame["g"] == g.k0] if groups else frame
            x = x[columns[slot]].dropna().to_numpy()
            assert [r.q1, r.median, r.q3] == pytest.approx(np.percentile(x, [25, 50, 75]).tolist(), rel=1e-12)
            assert r.n == len(x)
            mad = np.median(np.abs(x - np.median(x)))
            assert distances[g, slot].mad == pytest.approx(mad, rel=1e-9, abs=1e-12)


def test_infinite_medians(spark):
    inf = float("inf")
    df = spark.createDataFrame([(inf, inf), (inf, inf), (1.0, inf)], "a double, b double")
    with Profile(df) as p:
        found = {r["slot"]: (r["median"], r["mad"]) for r in p.deviations().collect()}
    assert found == {0: (inf, inf), 1: (inf, None)}


def test_no_second_sort(spark):
    """The outliers by distance need one table of sorted values and its index, and no more."""
    with Profile(spark.range(2000).selectExpr("cast(id as double) as x", "id * id as y")) as p:
        ops.outliers_mad(p).collect()
        assert {"ranges", "index", "parts", "medians"} == set(p._known)
