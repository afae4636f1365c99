"""The given tables, and a messy view of one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# name -> (kind, SQL over lineitem that both engines read the same way). Between them the columns
# trigger every detector: gaps, negatives, outliers, twins, constants, dates and codes in text.
MESSY_COLUMNS = {
    "order_id": ("bigint", "l_orderkey"),
    "line_no": ("int", "l_linenumber"),
    "return_flag": ("string", "l_returnflag"),
    "tax": ("double", "CASE WHEN l_linenumber IN (3, 6, 7) THEN NULL ELSE l_tax END"),
    "quantity": (
        "double", "CASE WHEN l_returnflag = 'R' AND l_discount = 0.0 THEN -l_quantity ELSE l_quantity END",
    ),
    "amount": (
        "double", "CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN l_extendedprice * 50 ELSE l_extendedprice END",
    ),
    "price": ("double", "l_extendedprice"),
    "price_copy": ("double", "l_extendedprice"),
    "gross": ("double", "l_extendedprice * 1.1 + l_linenumber"),
    "batch": ("string", "'x'"),
    "batch_no": ("int", "1"),
    "status_flag": ("string", "CASE WHEN l_shipdate < DATE '1995-03-01' THEN 'R' ELSE 'N' END"),
    "ship_text": ("string", "CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10))"),
    "code_text": ("string", "CASE WHEN l_linenumber = 1 THEN 'x-1' ELSE CAST(l_suppkey AS VARCHAR(20)) END"),
    "note": ("string", "CASE WHEN l_linenumber = 2 THEN '  ' ELSE l_returnflag END"),
    "churn_label": ("string", "l_linestatus"),
    "finished": ("boolean", "l_linestatus = 'F'"),
    "ship_day": ("date", "CAST(l_shipdate AS DATE)"),
    "empty_col": ("double", "CAST(NULL AS DOUBLE)"),
}
NUMERIC = [c for c, (t, _) in MESSY_COLUMNS.items() if t in ("bigint", "int", "double")]
TEXT = [c for c, (t, _) in MESSY_COLUMNS.items() if t == "string"]

# All rows, and once more those of a fortnight that was delivered twice.
MESSY_ROWS = (
    "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem "
    "WHERE l_shipdate >= DATE '1999-03-01' AND l_shipdate < DATE '1999-03-15'"
)


def messy_sql() -> str:
    columns = ", ".join(f"{sql} AS {name}" for name, (_, sql) in MESSY_COLUMNS.items())
    return f"SELECT {columns} FROM ({MESSY_ROWS}) AS delivered"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    # Both deliveries from one scan: a union would read the file a second time for the fortnight.
    again = "l_shipdate >= DATE '1999-03-01' AND l_shipdate < DATE '1999-03-15'"
    delivered = lines.selectExpr("*", f"explode(if({again}, array(1, 2), array(1))) as delivery")
    return delivered.selectExpr(*[f"{sql} AS {name}" for name, (_, sql) in MESSY_COLUMNS.items()])
