"""A table as the operators see it: neutral column names, cleaned values, optional groups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL, FLOAT, DECIMAL, TEXT, VARIANT, OTHER = "integral", "float", "decimal", "text", "variant", "other"
NUMERIC_KINDS = (INTEGRAL, FLOAT, DECIMAL)

# Bytes of one value of a fixed-width type.
_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGRAL
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(data_type, T.DecimalType):
        return DECIMAL
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, T.VariantType):
        return VARIANT
    return OTHER


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Field:
    """One profiled column. ``slot`` is its position; in plans the column is called ``c<slot>``."""

    slot: int
    name: str
    data_type: T.DataType

    @property
    def kind(self) -> str:
        return _kind(self.data_type)

    @property
    def is_numeric(self) -> bool:
        return self.kind in NUMERIC_KINDS

    @property
    def sql(self) -> str:
        return f"c{self.slot}"

    @property
    def number(self) -> str:
        """The column as a double, in SQL."""
        return self.sql if isinstance(self.data_type, T.DoubleType) else f"cast({self.sql} as double)"

    @property
    def width(self) -> int | None:
        if isinstance(self.data_type, T.DecimalType):
            return 8 if self.data_type.precision <= 18 else 16
        return _WIDTHS.get(type(self.data_type))

    @property
    def comparable(self) -> str:
        """The column in a form that can be compared and hashed (maps and variants cannot)."""
        return f"to_json({self.sql})" if isinstance(self.data_type, (T.MapType, T.VariantType)) else self.sql

    @property
    def key_text(self) -> str:
        """A text that is equal exactly when two values are equal."""
        if isinstance(self.data_type, T.BinaryType):
            return f"hex({self.sql})"
        if isinstance(self.data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return f"to_json({self.sql})"
        return f"cast({self.sql} as string)"


    @property
    def ordered(self) -> bool:
        """Whether the values are compared as they are at little cost: all types of fixed width."""
        return self.width is not None

    @property
    def key_hash(self) -> str:
        """A hash that differs only where two values do, null where the value is."""
        return f"if({self.sql} is null, null, xxhash64({self.key_text}))"


class Table:
    """The profiled columns of a DataFrame under neutral names, plus the groups.

    Columns are renamed to ``c0..cn``, and all group columns together become one struct ``g``, so
    that no name of the user's table can clash with a name used in a plan, and a group whose key
    is null is a group like any other. NaN counts as missing from here on.
    """

    def __init__(self, df: DataFrame, group_cols: Sequence[str] = (), columns: Sequence[str] | None = None):
        self.spark = df.sparkSession
        self.group_cols = tuple(group_cols)
        schema = df.schema.fields
        position = {f.name: i for i, f in enumerate(schema)}
        unknown = [c for c in (*self.group_cols, *(columns or ())) if c not in position]
        if unknown:
            raise ValueError(f"no such column: {', '.join(unknown)}")
        wanted = set(columns) if columns is not None else None
        profiled = [
            i for i, f in enumerate(schema)
            if f.name not in self.group_cols and (wanted is None or f.name in wanted)
        ]
        self.fields = [Field(slot, schema[i].name, schema[i].dataType) for slot, i in enumerate(profiled)]
        self.groups = ["g"] if self.group_cols else []

        select = []
        if self.groups:
            keys = ", ".join(f"r{position[c]} as k{n}" for n, c in enumerate(self.group_cols))
            select.append(f"struct({keys}) as g")
        for slot, i in enumerate(profiled):
            floating = isinstance(schema[i].dataType, (T.FloatType, T.DoubleType))
            select.append(f"if(isnan(r{i}), null, r{i}) as c{slot}" if floating else f"r{i} as c{slot}")
        self._raw, self._position, self._select = df.toDF(*[f"r{i}" for i in range(len(schema))]), position, select
        self.df = self._raw.selectExpr(*select)

    def with_sort_key(self, name: str) -> DataFrame:
        """The table and any column of the source, profiled or not, as ``sort_key``."""
        if name not in self._position:
            raise ValueError(f"no such column: {name}")
        return self._raw.selectExpr(*self._select, f"r{self._position[name]} as sort_key")

    @property
    def numeric(self) -> list[Field]:
        return [f for f in self.fields if f.is_numeric]

    @property
    def textual(self) -> list[Field]:
        return [f for f in self.fields if f.kind == TEXT]

    def names(self, slot: str = "slot") -> str:
        """Column name of a slot number, in SQL: the schema as a literal array."""
        return self.per_field([f.name for f in self.fields], slot)

    def types(self, slot: str = "slot") -> str:
        return self.per_field([f.data_type.simpleString() for f in self.fields], slot)

    def per_field(self, texts: list[str], slot: str = "slot") -> str:
        """The text of a slot number, from one text per column."""
        if not texts:
            return "cast(null as string)"
        return f"element_at(array({', '.join(map(quoted, texts))}), {slot} + 1)"

    def among(self, fields: Iterable[Field], slot: str = "slot") -> str:
        """Whether a slot number belongs to one of the fields, in SQL."""
        slots = ", ".join(str(f.slot) for f in fields)
        return f"{slot} in ({slots})" if slots else "false"

    def present(self, df: DataFrame, *expressions: str) -> DataFrame:
        """Result columns behind the group columns under their own names."""
        keys = [F.col(f"g.k{n}").alias(c) for n, c in enumerate(self.group_cols)]
        return df.select(*keys, *map(F.expr, expressions))

    def empty(self, ddl: str) -> DataFrame:
        """An empty table with the groups in front."""
        key = f"g {self.df.schema['g'].dataType.simpleString()}, " if self.groups else ""
        return self.spark.createDataFrame([], key + ddl)

    def attach(self, left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
        """Join per-column (or per-group) figures to ``left`` on the groups and ``keys``.

        Without groups the right side has a row per column at most, which the schema bounds, so it
        is broadcast. With groups its size follows the data: no hint, adaptive execution measures
        it and broadcasts only below its threshold, and splits a skewed group otherwise.
        """
        on: list[str] | Column = [*self.groups, *keys]
        if not self.groups:
            right = F.broadcast(right)
        # Neither groups nor keys: the figures of the whole table, one row.
        return left.join(right, on or F.lit(True), how)
