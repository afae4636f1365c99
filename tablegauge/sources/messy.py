"""A messy ten-column test table derived from row numbers.

The pseudo-random numbers are plain arithmetic on the row number, so the table is the same however
its rows are partitioned, and can be repeated in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_RANGE = 2147483648


def draw_sql(number: str, salt: int) -> str:
    """A whole number from 0 to 2^31 - 1 for a row number and a salt: two rounds of mixing."""
    first = f"(({number} % {_RANGE}) * {1103515245 + 2 * salt} + {salt * 7919}) % {_RANGE}"
    return f"((({first}) + cast(floor(({first}) / cast(32768 as double)) as bigint)) * 69069 + {salt}) % {_RANGE}"


def _share(number: str, salt: int) -> str:
    return f"(({draw_sql(number, salt)}) / cast({_RANGE} as double))"


def messy_columns_sql(number: str) -> dict[str, str]:
    """The columns in SQL over a row number (but for the text of the date)."""

    def one_in(n: int, salt: int) -> str:
        return f"({draw_sql(number, salt)}) % {n} = 0"

    def pick(salt: int, *steps: tuple[float, str]) -> str:
        whens = " ".join(f"when {_share(number, salt)} < {upto} then '{text}'" for upto, text in steps[:-1])
        return f"case {whens} else '{steps[-1][1]}' end"

    # Nearly normal: the sum of twelve uniform numbers.
    normal = " + ".join(_share(number, 20 + i) for i in range(12))
    income = f"round(55000 + 20000 * ({normal} - 6), 2)"
    return {
        "id": f"cast({number} as bigint)",
        "age": f"cast(18 + ({draw_sql(number, 1)}) % 72 as double)",
        "income": (
            f"case when {_share(number, 2)} < 0.04 then null when {one_in(500, 3)} "
            f"then round(130000 * (5 + 5 * {_share(number, 4)}), 2) else {income} end"
        ),
        "score": f"round(-50 * ln((({draw_sql(number, 5)}) + 1) / cast({_RANGE} as double)), 2)",
        "category": pick(6, (0.25, "A"), (0.5, "B"), (0.75, "C"), (1, "D")),
        "region": pick(7, (0.7, "north"), (0.8, "south"), (0.9, "east"), (1, "west")),
        "notes": pick(8, (0.85, ""), (0.95, "flagged"), (1, "reviewed")),
        "email": f"concat('user', cast({number} as varchar(20)), '@example.com')",
        "active": f"({draw_sql(number, 9)}) % 2 = 0",
    }


def source_row_sql(number: str) -> str:
    """The row whose content a row carries: one in 400 repeats the row before it."""
    return f"case when {number} > 0 and ({draw_sql(number, 10)}) % 400 = 0 then {number} - 1 else {number} end"


def generate_messy(numbers: DataFrame, number: str = "id") -> DataFrame:
    """The messy table over a table of row numbers, such as ``spark.range(n)`` or any integer key."""
    rows = numbers.selectExpr(f"{source_row_sql(f'cast(`{number}` as bigint)')} as n")
    made = messy_columns_sql("n")
    date = "date_format(timestampadd(MINUTE, n, timestamp_ntz'2020-01-01 00:00:00'), 'yyyy-MM-dd HH:mm:ss')"
    columns = [f"{sql} as {name}" for name, sql in made.items()]
    return rows.selectExpr(*columns[:4], f"{date} as signup_date", *columns[4:])
