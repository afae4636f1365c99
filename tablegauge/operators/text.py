"""Text columns: lengths, blanks, dates in text, mixed types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_date_text
from ..plans.profile import SPELLED, Profile
from ..plans.stats import aggregate
from ..plans.table import TEXT, VARIANT
from ..plans.values import LEXICAL_CLASSES
from .structure import named

LENGTHS = ("avg_length", "min_length", "max_length", "blank")


def text_column_stats(source, **options) -> DataFrame:
    """(position, column, avg_length, min_length, max_length, blank) of columns with values."""
    p = Profile.of(source, **options)
    counted = p.facts("filled", *LENGTHS, fields=p.table.textual).where("filled > 0")
    return named(p, counted, "round(avg_length, 1) as avg_length", *LENGTHS[1:])


def _first_values(p: Profile, sample_size: int, order_by: str) -> DataFrame:
    """(groups, slot, filled, dates) of the first values of each text column.

    Every task keeps its own first values before the shuffle, so no column is gathered.
    """
    cells = ", ".join(f"struct({f.slot} as slot, {f.sql} as value)" for f in p.table.textual)
    text = p.table.with_sort_key(order_by).selectExpr(*p.table.groups, "sort_key", f"inline(array({cells}))")
    nth = f"row_number() over (partition by {', '.join(p.keys)} order by sort_key, value) as nth"
    first = text.where("value is not null").selectExpr("*", nth).where(f"nth <= {sample_size}")
    dated = first.withColumn("is_date", is_date_text(F.col("value")))
    return aggregate(dated, p.keys, ["count(1) as filled", "count_if(is_date) as dates"])


def date_like_columns(source, sample_size: int | None = None, order_by: str | None = None, **options) -> DataFrame:
    """(position, column, share): text columns whose values read as dates.

    All values are looked at. ``sample_size`` with ``order_by`` looks at the first ones in the
    order of a column instead.
    """
    p = Profile.of(source, **options)
    if (sample_size is None) != (order_by is None):
        raise ValueError("sample_size and order_by go together: a table has no order of its own")
    if sample_size is None:
        found = p.flagged("date_like", fields=p.table.textual)
    else:
        found = _first_values(p, sample_size, order_by).where(p.flags["date_like"][1])
    return named(p, found, "round(dates / filled, 4) as share")


def mixed_type_columns(source, **options) -> DataFrame:
    """(position, column, types). A typed column is never mixed; a variant column can be.

    With ``mixed="lexical"`` a text column is, if its values spell more than one class (see ``Profile``).
    """
    p = Profile.of(source, **options)
    if p.mixed == "lexical":
        fields = [f for f in p.table.fields if f.kind in (VARIANT, TEXT)]
        return named(p, p.flagged("mixed_type", fields=fields), f"coalesce(variant_types, {SPELLED}) as types")
    variants = [f for f in p.table.fields if f.kind == VARIANT]
    return named(p, p.flagged("mixed_type", fields=variants), "variant_types as types")


def lexical_types(source, **options) -> DataFrame:
    """(position, column, class, count): what the texts of a column spell."""
    p = Profile.of(source, **options)
    counts = ", ".join(f"struct('{c}' as class, n_{c} as count)" for c in LEXICAL_CLASSES)
    spelled = p.text().selectExpr(*p.keys, f"inline(array({counts}))").where("count > 0")
    return named(p, spelled, "class", "count")
