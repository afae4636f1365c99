import json

import pytest
from pyspark.sql import types as T

from tablegauge import Profile
from tablegauge import operators as ops
from tablegauge.constants import DEDUCTION_CAPS
from tablegauge.operators.report import SECTIONS
from workload.tables import messy


def scores(df, **options):
    return ops.health_score(df, **options).collect()[0].asDict()


def test_clean_table(table):
    df = table(
        "shelf int, depth double, wood string",
        shelf=list(range(60)), depth=[200 - k / 4 for k in range(60)], wood=["oak", "ash", "elm", "fir"] * 15,
    )
    found = scores(df)
    # The two numbers run in step, which costs a point.
    assert found["score"] >= 90 and found["grade"] == "Excellent" and set(DEDUCTION_CAPS) < set(found)


def test_table_without_columns(spark):
    found = scores(spark.createDataFrame([], T.StructType([])))
    assert found["score"] == 100 and found["grade"] == "Excellent"
    assert ops.findings(spark.createDataFrame([], T.StructType([]))).collect() == []


def test_table_without_rows(spark):
    found = scores(spark.createDataFrame([], "a int, b string"))
    assert found["constant_columns"] == 6.0 and found["score"] == 94


def test_one_severely_missing_column(table):
    df = table("a int, b int", a=[None] * 12 + list(range(38)), b=[k % 11 for k in range(50)])
    assert scores(df)["missing_values"] == pytest.approx(25 * (0.7 * 0.24 + 0.3 * 0.24 / 2), abs=0.06)


def test_twins_and_constants(table):
    found = scores(table("left int, right int, still int", left=[4, 8, 6, 9, 5, 7], right=[4, 8, 6, 9, 5, 7], still=[0] * 6))
    assert found["duplicate_columns"] == 3.0 and found["constant_columns"] == 3.0 and found["correlated_columns"] == 1.0


def test_worse_data_scores_lower(table):
    clean = table("u int, v int", u=[k % 23 for k in range(70)], v=[(k * 29) % 71 for k in range(70)])
    torn = [k if k % 3 else None for k in range(70)]
    messy = table("u int, again int, v int", u=torn, again=torn, v=[6] * 70)
    assert scores(messy)["score"] < scores(clean)["score"]


def test_golden_formula(spark):
    # 86.5 % and 3.8 % missing in two of ten columns.
    columns = [f"id % 7 as c{i}" for i in range(8)]
    df = spark.range(1000).selectExpr(*columns, "if(id < 865, null, id % 5) as notes", "if(id < 38, null, id % 9) as income")
    assert scores(df)["missing_values"] == 15.8


def test_points_add_up_per_group(spark):
    df = spark.range(900).selectExpr(
        "if(id % 3 = 0, null, id % 3) as k", "if(id % 3 = 1 and id % 2 = 0, null, id) as a", "id % 10 as b", "1 as c"
    )
    rows = ops.health_score(df, group_cols=["k"]).collect()
    assert len(rows) == 3
    for r in rows:
        assert r["score"] == round(100 - sum(r[c] for c in DEDUCTION_CAPS))
    by_key = {r["k"]: r for r in rows}
    assert by_key[None]["missing_values"] == 0.0 and by_key[1]["missing_values"] > 5
    # A group alone scores as it does among others.
    alone = scores(df.where("k = 1").drop("k"))
    assert {c: alone[c] for c in DEDUCTION_CAPS} == {c: by_key[1][c] for c in DEDUCTION_CAPS}


def test_breakdown(table):
    df = table("a int, a_copy int, constant int", a=[1, 2, 3, 4, 5], a_copy=[1, 2, 3, 4, 5], constant=[1] * 5)
    rows = [(r["category"], r["points"]) for r in ops.score_breakdown(df).collect()]
    assert rows == [("constant_columns", 3.0), ("duplicate_columns", 3.0), ("correlated_columns", 1.0)]


def test_findings(table):
    df = table(
        "value int, constant_col string, with_nulls double, dup_of_value int, created string, age int",
        value=[10, 12, 11, 13, 1000], constant_col=["A"] * 5, with_nulls=[1.0, None, 3.0, None, 5.0],
        dup_of_value=[10, 12, 11, 13, 1000], created=["2024-01-0%d" % i for i in range(1, 6)], age=[1, -1, 2, 2, 3],
    )
    rows = ops.findings(df).collect()
    assert [r["rule_no"] for r in rows] == sorted(r["rule_no"] for r in rows)
    messages = [r["message"] for r in rows]
    assert "🚨 Column 'with_nulls' has high missingness (40.0%)." in messages
    assert "⚠️ Column 'constant_col' is constant (no variation)." in messages
    assert "📊 Column 'value' has 1 potential outlier(s) (MAD method)." in messages
    assert "🧬 Columns 'value' and 'dup_of_value' are identical." in messages
    assert "🔗 Columns 'value' and 'dup_of_value' are highly correlated (1.0)." in messages
    assert "📅 Column 'created' looks like it contains dates (consider parsing as datetime)." in messages
    assert "➖ Column 'age' contains unexpected negative values." in messages
    assert any(m.startswith("📐 Column 'value' is heavily skewed (skew=2.2") for m in messages)
    severity = {r["rule"]: r["severity"] for r in rows}
    assert severity["missingness"] == "danger" and severity["constant"] == "warning" and severity["skewed"] == ""


def test_gate(table):
    df = table("a int, b int", a=[1, 2, 3, 4, 1000], b=[1, 2, None, None, 5])
    limits = {"outliers_mad": ("max", 0), "missing_percentage": ("max", 50), "score": ("min", 10)}
    passed = {r["check"]: r["passed"] for r in ops.quality_gate(df, limits).collect()}
    assert passed == {"outliers_mad": False, "missing_percentage": True, "score": True}


def test_full_profile_and_json(table):
    df = table(
        "id int, value int, with_nulls double, t string", id=[1, 2, 3, 4, 5], value=[10, 12, 11, 13, 1000],
        with_nulls=[1.0, None, 3.0, None, 5.0], t=["a", "b", " ", "b", "c"],
    )
    with Profile(df) as p:
        report = ops.full_profile(p).collect()[0].asDict(recursive=True)
        document = json.loads(ops.report_json(p).collect()[0]["report"])
    assert tuple(report) == SECTIONS == tuple(document) and len(SECTIONS) == 25
    assert report["shape"] == {"rows": 5, "columns": 4}
    assert report["boxplot_stats"]["value"]["outliers"] == [1000.0]
    assert sum(report["histogram_data"]["value"]["counts"]) == 5
    assert len(report["histogram_data"]["value"]["bin_edges"]) == 11
    assert report["correlation_matrix"]["id"]["id"] == 1.0
    assert report["distribution_shape"]["with_nulls"]["kurtosis"] is None
    assert document["text_column_stats"]["t"]["blank_or_whitespace_only"] == 1
    assert document["duplicate_columns"] == []


def test_full_profile_per_group(spark):
    df = spark.range(300).selectExpr("id % 2 as k", "id as a", "id % 7 as b", "cast(id % 3 as string) as t")
    rows = {r["k"]: r for r in ops.full_profile(df, group_cols=["k"]).collect()}
    assert set(rows) == {0, 1} and rows[0]["shape"]["rows"] == 150
    assert rows[1]["missing_values"] == {"a": 0, "b": 0, "t": 0}


def test_profile_tables_history(spark, tmp_path):
    folder = str(tmp_path / "history")
    df = spark.range(50).selectExpr("id", "id % 3 as b")
    ops.write_profile(df, folder, run="2024-01-01")
    ops.write_profile(df.where("id < 10"), folder, run="2024-01-02")
    rows = spark.read.parquet(f"{folder}/shape").collect()
    assert sorted((str(r["run"]), r["rows"]) for r in rows) == [("2024-01-01", 50), ("2024-01-02", 10)]
    # A repeated run replaces its rows, also where nothing is found any more.
    ops.write_profile(df.selectExpr("b * 7 % 5 as b").where("b < 4"), folder, run="2024-01-01")
    shapes = spark.read.parquet(f"{folder}/shape").collect()
    assert sorted((str(r["run"]), r["rows"], r["columns"]) for r in shapes) == [("2024-01-01", 34, 1), ("2024-01-02", 10, 2)]
    found = spark.read.parquet(f"{folder}/high_cardinality_columns").collect()
    assert {str(r["run"]) for r in found} == {"2024-01-02"}


def test_json_safe(spark):
    df = spark.sql("select double('nan') as a, array(double('inf'), 1D) as b, struct(double('-inf') as x) as c, map('k', 1D) as d")
    row = ops.json_safe(df).collect()[0]
    assert row["a"] is None and row["b"] == [None, 1.0] and row["c"]["x"] is None and row["d"] == {"k": 1.0}


def test_close_removes_written_tables(spark, tmp_path):
    import os

    df = spark.range(100).selectExpr("cast(id as double) as a")
    p = Profile(df)
    ops.iqr_bounds(p).collect()
    folder = p.staging.path("ranges")
    assert os.path.isdir(folder)
    p.close()
    assert not os.path.exists(folder)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_only_the_bases_behind_a_figure(spark, tmp_path):
    """A gate on rows is one scan and computes no base; the score needs no fences and no dates in text."""
    path = str(tmp_path / "t")
    spark.sql("select id, id % 7 as k, cast(id % 3 as string) as t, id * 2.5D as x from range(300)").write.parquet(path)
    df = spark.read.parquet(path)
    with Profile(df) as p:
        gate = ops.quality_gate(p, {"rows": ("min", 1)})
        assert scans(gate) == 1 and not p._known and p.staging._folder is None
        assert [tuple(r) for r in gate.collect()] == [("rows", 300.0, "min", 1.0, True)]
    with Profile(df) as p:
        gate = ops.quality_gate(p, {"duplicate_rows": ("max", 0), "rows": ("min", 301)})
        assert set(p._known) == {"duplicates"}
        assert {r.check: r.passed for r in gate.collect()} == {"duplicate_rows": True, "rows": False}
    with Profile(df) as p:
        score = ops.health_score(p).first()
        assert not {"quartiles", "iqr", "text", "facts"} & set(p._known) and "medians" in p._known
        assert not {"avg_length", "bytes", "kurt"} & set(p._known["stats"].columns)
        p.gather()
        assert ops.health_score(p).first() == score == ops.health_score(df).first()
        limits = spark.createDataFrame([("outliers_iqr", "max", 5.0), ("nothing", "max", 1.0)], "check string, bound string, limit double")
        assert {r.check: r.actual for r in ops.quality_gate(p, limits).collect()} == {"outliers_iqr": 0.0, "nothing": None}


def test_messy_view_reads_its_table_once(spark, tmp_path):
    columns = (
        "id as l_orderkey, 1 + cast(id % 7 as int) as l_linenumber, 0.1D as l_discount, 0.02D as l_tax, id * 2D as l_quantity, "
        "id * 9D as l_extendedprice, id % 5 as l_suppkey, 'N' as l_returnflag, 'F' as l_linestatus, "
        "if(id % 10 = 0, null, timestamp'1999-02-25 12:00:00' + make_dt_interval(int(id))) as l_shipdate"
    )
    spark.sql(f"select {columns} from range(30)").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = messy(spark, str(tmp_path))
    assert scans(found) == 1
    lines = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    twice = [r["l_orderkey"] for r in lines.where("l_shipdate >= DATE '1999-03-01' AND l_shipdate < DATE '1999-03-15'").collect()]
    assert twice and sorted(r["order_id"] for r in found.collect()) == sorted([*range(30), *twice])
