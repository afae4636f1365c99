"""Built-in Spark SQL expressions: names, text classes, dates, numeric helpers.

Everything here is a plain ``Column`` built from JVM functions, so it stays inside
whole-stage code generation wherever Spark supports that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ID_NAME_WORDS, TARGET_NAME_WORDS

# Characters a blank cell may consist of: Unicode white space plus the four ASCII separators.
_BLANK = r"r'(?U)^[\s\x1c-\x1f]*$'"

# Anchored shapes guard every parse, so that free text and id-like numbers never reach a cast.
# (shape, expression over the trimmed text that is non-null when the date exists)
_MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?)"
)
_YEAR = r"(1[6-9]|2[0-2])\d\d"
_TIME = r"([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?"
_ZONE = r"( ?(Z|UTC|[+-]\d\d:?\d\d))?"


def name_words_sql(name: str) -> str:
    """Lower-case whole words of a column name; camelCase, snake_case and kebab-case are split."""
    spaced = f"regexp_replace({name}, '(?<=[a-z0-9])(?=[A-Z])', ' ')"
    return f"filter(split(lower({spaced}), '[^a-z0-9]+'), w -> w <> '')"


def _has_word_sql(name: str, words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"arrays_overlap({name_words_sql(name)}, array({listed}))"


def id_name_sql(name: str) -> str:
    """Whether a word of the name marks an identifier."""
    return _has_word_sql(name, ID_NAME_WORDS)


def target_name_sql(name: str) -> str:
    """Whether the name suggests the target of a model."""
    return f"(lower(trim({name})) = 'y' or {_has_word_sql(name, TARGET_NAME_WORDS)})"


def blank_sql(text: str) -> str:
    """Whether a text is empty or white space, in SQL."""
    return f"rlike({text}, {_BLANK})"


def _real_day(year: Column, month: Column, day: Column) -> Column:
    """Whether the three texts name a day of the calendar."""
    padded = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return padded.try_cast("date").isNotNull()


def is_date_text(text: Column) -> Column:
    """Whether a text reads as a date or time in one of the accepted shapes (never null)."""
    t = F.trim(text)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group)

    # The day's shape names its parts; what follows is an optional time and zone.
    rest = rf"([ T]{_TIME}{_ZONE})?$"
    dashed = rf"^({_YEAR})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){rest}"
    packed = rf"^({_YEAR})(\d\d)(\d\d)$"
    slashed = rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-]({_YEAR}){rest}"
    month_first = rf"(?i)^{_MONTH}\.? (\d{{1,2}}),? ({_YEAR}){rest}"
    day_first = rf"(?i)^(\d{{1,2}})[ -]{_MONTH}[ -]({_YEAR}){rest}"

    def month_number(name: Column) -> Column:
        at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3)))
        return ((at + 2) / 3).cast("int").cast("string")

    first, second, year = part(slashed, 1), part(slashed, 2), part(slashed, 3)
    # Month first; day first where the first number cannot be a month.
    swapped = first.try_cast("int") > 12
    shapes = (
        F.when(t.rlike(rf"^{_YEAR}(-(0[1-9]|1[0-2])|Q[1-4])?$"), True)
        .when(t.rlike(rf"^{_TIME}$"), True)
        .when(t.rlike(dashed), _real_day(part(dashed, 1), part(dashed, 3), part(dashed, 4)))
        .when(t.rlike(packed), _real_day(part(packed, 1), part(packed, 3), part(packed, 4)))
        .when(
            t.rlike(slashed),
            _real_day(year, F.when(swapped, second).otherwise(first), F.when(swapped, first).otherwise(second)),
        )
        .when(
            t.rlike(month_first),
            _real_day(part(month_first, 3), month_number(part(month_first, 1)), part(month_first, 2)),
        )
        .when(
            t.rlike(day_first),
            _real_day(part(day_first, 3), month_number(part(day_first, 2)), part(day_first, 1)),
        )
        .when(F.lower(t).isin("now", "today"), True)
        .otherwise(False)
    )
    return F.when(F.length(text) > 0, shapes).otherwise(False)


INTEGER_SHAPE = r"^\s*[+-]?\d+\s*$"
DECIMAL_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
BOOLEAN_WORDS = ("true", "false")


def lexical_class(text: Column, is_date: Column) -> Column:
    """What a text spells: integer, decimal, boolean, date or text. ``is_date``: is_date_text."""
    return (
        F.when(text.rlike(INTEGER_SHAPE), "integer")
        .when(text.rlike(DECIMAL_SHAPE), "decimal")
        .when(F.lower(F.trim(text)).isin(*BOOLEAN_WORDS), "boolean")
        .when(is_date, "date")
        .otherwise("text")
    )


def finite_sql(value: str) -> str:
    """NaN and infinities become null: what JSON can carry."""
    return f"if(abs({value}) < double('Infinity'), {value}, null)"


def not_nan_sql(value: str) -> str:
    """NaN becomes null; comparisons with NaN would be true in Spark."""
    return f"nanvl({value}, null)"


def rounded_sql(*names: str) -> list[str]:
    """Three decimals, as reported."""
    return [f"round({finite_sql(n)}, 3) as {n}" for n in names]


# Missing cells in percent of the rows, two decimals; null for an empty table.
PERCENTAGE = "round(missing / nullif(rows, 0) * 100, 2)"
