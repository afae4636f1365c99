"""Times the headline measurements and prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all)

The headline is the full profile of ``lineitem``, from reading the file to the collected report, as
the median of three runs. One run on the smallest tables before it loads and compiles the code.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablegauge import Profile  # noqa: E402
from tablegauge import operators as ops  # noqa: E402
from tablegauge.session import local_session  # noqa: E402
from tablegauge.sources import generate_messy  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
RUNS = 3


def full_profile(df):
    with Profile(df) as p:
        return ops.full_profile(p).collect()


def measured(operator, table: str, **options):
    def run(tables):
        with Profile(tables(table), **options) as p:
            return operator(p).collect()

    return run


WORK = {
    "full_profile_lineitem": lambda tables: full_profile(tables("lineitem")),
    "full_profile_generated": lambda tables: full_profile(generate_messy(tables("orders"), "o_orderkey")),
    "full_profile_documents": lambda tables: full_profile(tables("documents")),
    "health_score_by_group": measured(ops.health_score, "lineitem", group_cols=["l_returnflag"]),
    "missing_percentage": measured(ops.missing_percentage, "lineitem"),
    "duplicate_rows": measured(ops.duplicate_rows, "lineitem"),
    "unique_counts": measured(ops.unique_counts, "lineitem"),
    "duplicate_columns": measured(ops.duplicate_columns, "lineitem"),
    "distribution_shape": measured(ops.distribution_shape, "lineitem"),
    "correlation_matrix": measured(ops.correlation_matrix, "lineitem"),
    "histogram": measured(ops.histogram, "lineitem"),
    "outliers_iqr": measured(ops.outliers_iqr, "lineitem"),
    "outliers_mad": measured(ops.outliers_mad, "lineitem"),
    "outliers_mad_approx": measured(ops.outliers_mad, "lineitem", mode="approx"),
    "text_column_stats": measured(ops.text_column_stats, "documents"),
    "lexical_types": measured(ops.lexical_types, "documents"),
}


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    warm_up = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    seconds = {}
    for name, work in WORK.items():
        if os.path.isdir(warm_up):
            work(lambda t: spark.read.parquet(f"{warm_up}/{t}.parquet"))
        times = []
        for _ in range(RUNS):
            started = time.perf_counter()
            work(lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet"))
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times), 3)
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "full profile of lineitem (25 sections), median of 3",
        "value": seconds["full_profile_lineitem"],
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rows": rows,
        "rows_per_second": round(rows / seconds["full_profile_lineitem"]),
        "cpus": CPUS,
    }))


if __name__ == "__main__":
    main()
