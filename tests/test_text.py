import pytest
from pyspark.sql import functions as F

from tablegauge import operators as ops
from tablegauge.functions.expressions import is_date_text

DATES = [
    "2024", "20240101", "2024-01", "2024-01-01", "2024-01-01 10:00", "2024-01-01T10:00:00Z", "01/02/2024",
    "13/02/2024", "Jan 5 2024", "5 January 2024", "12:30", "2024Q1", "now", "today",
]
NO_DATES = [
    "10", "1.5", "-5", "12345678", "1/2", "may", "monday", "AM", "x", "Brand#2", "user1@example.com", "2024-13-45",
    "90210", "123456", "0012", "", "   ", "2024-02-30", "31/31/2024",
]


def test_date_texts(spark):
    df = spark.createDataFrame([(t,) for t in DATES + NO_DATES], "t string")
    found = {r["t"]: r["is_date"] for r in df.withColumn("is_date", is_date_text(F.col("t"))).collect()}
    assert [t for t in DATES if not found[t]] == []
    assert [t for t in NO_DATES if found[t]] == []


def test_date_like_columns(table):
    df = table(
        "n int, created_at string, name string, late string", n=[1, 2, 3, 4, 5],
        created_at=["2024-01-01", "2024-02-01", "2024-03-01", None, "soon"][:4] + ["2024-04-01"],
        name=list("abcde"), late=["x", "2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"],
    )
    assert {r["column"] for r in ops.date_like_columns(df).collect()} == {"created_at", "late"}
    first = ops.date_like_columns(df, sample_size=2, order_by="n").collect()
    assert [r["column"] for r in first] == ["created_at"]
    with pytest.raises(ValueError):
        ops.date_like_columns(df, sample_size=2)


def test_text_stats(table):
    df = table("t string, none string", t=["a", "", " \t", " ", "日本語", None], none=[None] * 6)
    rows = ops.text_column_stats(df).collect()
    assert len(rows) == 1
    assert (rows[0]["avg_length"], rows[0]["min_length"], rows[0]["max_length"], rows[0]["blank"]) == (1.4, 0, 3, 3)


def test_mixed_types(spark, table):
    df = spark.sql("select parse_json(v) as mixed, parse_json('1') as same, v as t from values ('1'), ('\"2\"'), ('3') as x(v)")
    assert [(r["column"], r["types"]) for r in ops.mixed_type_columns(df).collect()] == [("mixed", 2)]
    assert ops.mixed_type_columns(table("t string", t=["1", "b"])).collect() == []


def test_lexical_types(table):
    df = table("t string", t=["1", "-2", "1.5", "1e3", "true", "2024-01-05", "word", "2024", None, "1" * 60, "7" * 90, " " * 45 + "2024-01-06",
                                    " " * 70 + "false", "x" * 200, "September 12, 2024 10:00:00.123456789 +05:30"])
    found = {r["class"]: r["count"] for r in ops.lexical_types(df).collect()}
    assert found == {"integer": 5, "decimal": 2, "boolean": 2, "date": 3, "text": 2}
