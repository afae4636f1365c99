from tablegauge import Profile
from tablegauge import operators as ops


def names(df):
    return [r["column"] for r in df.orderBy("position").collect()]


def sample(table):
    return table(
        "pump int, litres int, site string, pressure double, drained int",
        pump=[71, 72, 73, 74, 75, 76, 77, 78],
        litres=[40, 38, 41, 40, 39, 7300, 42, 37],
        site=["north"] * 8,
        pressure=[0.8, float("nan"), 1.1, None, 0.9, None, 1.0, 1.2],
        drained=[40, 38, 41, 40, 39, 7300, 42, 37],
    )


def test_shape_and_missing(table):
    df = sample(table)
    assert ops.shape(df).collect() == [(8, 5)]
    missing = {r["column"]: r["missing"] for r in ops.missing_values(df).collect()}
    assert missing["pressure"] == 3 and missing["pump"] == 0
    assert {r["column"]: r["percentage"] for r in ops.missing_percentage(df).collect()}["pressure"] == 37.5


def test_missing_percentage_of_an_empty_table(table, spark):
    assert ops.missing_percentage(spark.createDataFrame([], "a int, b string")).collect() == []


def test_duplicate_rows(table):
    assert ops.duplicate_rows(sample(table)).collect()[0][0] == 0
    nan = float("nan")
    df = table("a double, b string", a=[1.0, 1.0, None, nan, 0.0, -0.0, 2.0], b=["x", "x", None, None, "z", "z", "y"])
    assert ops.duplicate_rows(df).collect()[0][0] == 3


def test_duplicate_rows_tells_shifted_nulls_apart(table):
    df = table("a string, b string", a=["x", None], b=[None, "x"])
    assert ops.duplicate_rows(df).collect()[0][0] == 0


def test_duplicate_rows_with_one_hot_row(spark):
    df = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id) as a", "cast(if(id % 3 = 0, 0, id) as string) as b")
    assert ops.duplicate_rows(df).collect()[0][0] == 2999


def test_constant_and_near_constant(table):
    df = table(
        "valve string, reading int, c int, gone double",
        valve=["shut"] * 38 + ["open"] * 2, reading=[k * k for k in range(40)], c=[9] * 40, gone=[None] * 40,
    )
    assert names(ops.constant_columns(df)) == ["c", "gone"]
    assert names(ops.near_constant_columns(df)) == ["valve"]
    varied = table("v string", v=["shut"] * 37 + ["open"] * 3)
    assert names(ops.near_constant_columns(varied)) == []


def test_every_column_of_an_empty_table_is_constant(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert names(ops.constant_columns(df)) == ["a", "b"]
    assert ops.high_cardinality(df).collect() == []


def test_unique_counts_keep_values_apart(table):
    big = 2**53
    long_text = "x" * 5000
    df = table(
        "i bigint, f double, t string, flags array<int>",
        i=[big, big + 1, None], f=[0.0, -0.0, float("nan")], t=[long_text + "a", long_text + "b", None],
        flags=[[1, 2], [1, 2], [2, 1]],
    )
    assert {r["column"]: r["distinct_values"] for r in ops.unique_counts(df).collect()} == {
        "i": 2, "f": 1, "t": 2, "flags": 2,
    }


def test_high_cardinality(table):
    n = 50
    df = table(
        "weight double, parcel_code int, queue int, street string, lane string",
        weight=[3.5 + i / 8 for i in range(n)], parcel_code=[i * i + 17 for i in range(n)],
        queue=list(range(-7, n - 7)), street=[f"{i} canal row" for i in range(n)], lane=["p", "q"] * 25,
    )
    assert names(ops.high_cardinality(df)) == ["parcel_code", "queue", "street"]


def test_sequential_integers(table):
    df = table(
        "run int, gap int, half double, whole double, none int",
        run=[3, 1, 2], gap=[1, 2, 4], half=[1.0, 1.5, 2.0], whole=[5.0, 6.0, 7.0], none=[None] * 3,
    )
    found = {r["column"]: r["sequential"] for r in ops.sequential_integers(df).collect()}
    assert found == {"run": True, "gap": False, "half": False, "whole": True, "none": False}


def test_sequential_integers_at_the_ends_of_the_type(table):
    df = table("i bigint", i=[-(2**63), 2**63 - 1])
    assert ops.sequential_integers(df).collect()[0]["sequential"] is False


def test_duplicate_columns_need_the_same_type(table):
    df = table("a int, b int, c double, d int", a=[1, 2, None], b=[1, 2, None], c=[1.0, 2.0, None], d=[2, 1, None])
    assert [(r["column_a"], r["column_b"]) for r in ops.duplicate_columns(df).collect()] == [("a", "b")]


def test_duplicate_columns_of_a_wide_table(spark):
    columns = [f"(id * {i + 3}) % 17 as c{i}" for i in range(20)] + ["(id * 5) % 17 as twin", "17 - id % 17 as other"]
    df = spark.range(500).selectExpr(*columns)
    found = sorted((r["column_a"], r["column_b"]) for r in ops.duplicate_columns(df).collect())
    assert ("c2", "twin") in found
    by_value = {c: tuple(r[c] for r in df.collect()) for c in df.columns}
    expected = sorted(
        (a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1 :] if by_value[a] == by_value[b]
    )
    assert found == expected


def test_target_columns(table):
    def targets(**columns):
        return names(ops.possible_target_columns(table(", ".join(f"{c} int" for c in columns), **columns)))

    assert targets(age=[1], income=[2], churn=[0]) == ["churn"]
    assert targets(x1=[1], x2=[2], y=[0]) == ["y"]
    assert targets(TotalPay=[1], y_coordinate=[2]) == []
    assert targets(isChurnLabel=[1], classy=[2]) == ["isChurnLabel"]


def test_name_words(spark):
    df = spark.createDataFrame([("employeeID-no_2X",), ("__",), ("HTTPStatus",)], "column string")
    words = [(r["column"], r["word"]) for r in ops.word_lists(df).orderBy("column", "nth").collect()]
    assert words == [
        ("HTTPStatus", "httpstatus"), ("employeeID-no_2X", "employee"), ("employeeID-no_2X", "id"),
        ("employeeID-no_2X", "no"), ("employeeID-no_2X", "2"), ("employeeID-no_2X", "x"),
    ]


def test_names_with_dots_quotes_and_clashes(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", 1.0)], "`a.b` int, `it's` string, slot double")
    assert names(ops.missing_values(df)) == ["a.b", "it's", "slot"]
    assert names(ops.constant_columns(df)) == ["it's", "slot"]


def test_memory_and_types(table):
    df = table("a int, t string", a=[1, None], t=["é", None])
    assert [(r["column"], r["kilobytes"]) for r in ops.memory_usage(df).collect()] == [("a", 0.01), ("t", 0.0)]
    assert [(r["type"], r["filled"]) for r in ops.column_types(df).collect()] == [("int", 1), ("string", 1)]
    narrow = ops.recommended_types(table("a bigint, b bigint", a=[1, 2], b=[1, 70000])).collect()
    assert [r["recommended"] for r in narrow] == ["tinyint", "int"]


def test_constant_columns_without_counting_values(spark):
    """Of any type, per group, and without a base of distinct values."""
    df = spark.sql(
        "select if(id < 4, 'a', 'b') as k, 'x' as t, if(id = 9, 'y', 'x') as u, if(id % 2 = 0, 'x', 'X') collate utf8_lcase as l, "
        "array(1, 2) as n, array(id) as m, map('a', id % 1) as h, cast(0.5 as decimal(30, 2)) as d, "
        "9007199254740992 + id % 2 as far, if(id % 2 = 0, 0D, -0D) as z, if(id < 3, double('NaN'), 1D) as nan, "
        "date'2024-01-01' as day, id % 2 = 0 as odd, cast(null as string) as gone, repeat('x', 80) as long from range(10)"
    )
    constant = ["t", "n", "h", "d", "z", "nan", "day", "gone", "long"]
    assert names(ops.constant_columns(df.drop("k"))) == constant
    grouped = ops.constant_columns(df, group_cols=["k"]).collect()
    assert sorted(r["column"] for r in grouped if r["k"] == "a") == sorted([*constant, "u"])
    assert sorted(r["column"] for r in grouped if r["k"] == "b") == sorted(constant)
    with Profile(df, group_cols=["k"]) as p:
        costs = {r["k"]: r["constant_columns"] for r in ops.health_score(p).collect()}
        assert costs == {"a": 10.0, "b": 10.0} and "uniques" not in p._known
        assert names(ops.constant_columns(p)) == names(ops.constant_columns(p))


def test_rows_are_read_once_where_no_hash_is_shared(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select if(id % 3 = 0, 0, id) as a, id % 2 as k from range(300)").write.parquet(path)
    found = ops.duplicate_rows(spark.read.parquet(path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 0
    assert found.collect()[0][0] == 98
    by_group = Profile(spark.read.parquet(path), group_cols=["k"])
    assert sorted(tuple(r) for r in by_group.duplicates().collect()) == sorted(tuple(r) for r in by_group.duplicates().collect())
