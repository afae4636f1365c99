"""Registered queries against their SQL counterparts on the smallest tables.

A choice that covers every base; TABLEGAUGE_ALL=1 runs all of them, as tools/check_queries.py does.
"""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import rows_of
from workload.tables import TABLES

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = [
    "column_types", "duplicate_rows_by_group", "unique_counts_documents", "near_constant_columns",
    "outliers_mad_by_group", "histogram_events", "boxplot_outliers", "correlation_matrix", "lexical_types",
    "text_column_stats", "health_score_by_group", "findings", "read_csv", "quick_scan", "generate_messy",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()) if os.environ.get("TABLEGAUGE_ALL") else CHOSEN)
def test_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    mine = rows_of(df.columns, df.collect())
    if name not in oracle_sql():
        assert mine
        return
    found = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows_of(columns, found.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 1


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())
