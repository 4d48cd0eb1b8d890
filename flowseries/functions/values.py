"""Typed values: a type tag and one column for each type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowseries.schema import BOOLEAN, FLOAT, INT, STRING, TYPE_NAMES, VALUE_COLUMNS


def type_name(tag: Column) -> Column:
    return F.get(F.array(*map(F.lit, TYPE_NAMES)), tag)


def type_column(tag: Column) -> Column:
    return F.get(F.array(*map(F.lit, VALUE_COLUMNS)), tag)


def type_tag(name: Column) -> Column:
    """Tag of a type name, null for other names."""
    return F.nullif(F.array_position(F.array(*map(F.lit, TYPE_NAMES)), name), F.lit(0)).cast("int") - 1


def typed(tag: int, value: Column) -> list[Column]:
    """``type`` and the value columns of one typed value."""
    kinds = ("long", "double", "boolean", "string")
    cells = [(value if i == tag else F.lit(None)).cast(k).alias(c) for i, (c, k) in enumerate(zip(VALUE_COLUMNS, kinds, strict=True))]
    return [F.lit(tag).alias("type"), *cells]


def value_num() -> Column:
    """Int and Float values as a double; null for other types."""
    return F.coalesce("value_float", F.col("value_int").cast("double"))


def value_string() -> Column:
    """Any value as text; booleans as 1 or 0."""
    return F.coalesce(F.col("value_text"), F.col("value_bool").cast("int").cast("string"), F.col("value_int").cast("string"), F.col("value_float").cast("string"))


def as_int() -> Column:
    return F.when(F.col("type") == INT, F.col("value_int"))


def as_float() -> Column:
    return F.when(F.col("type") == FLOAT, F.col("value_float"))


def same_type(a: Column, b: Column) -> Column:
    return a == b


_OPERATORS = {">": Column.__gt__, "<": Column.__lt__, "=": Column.__eq__, ">=": Column.__ge__, "<=": Column.__le__}


def where_value(points: DataFrame, op: str, literal: int | float | bool | str) -> DataFrame:
    """Points whose value of the literal's type compares as asked; values of other types don't match."""
    tag = BOOLEAN if isinstance(literal, bool) else INT if isinstance(literal, int) else FLOAT if isinstance(literal, float) else STRING
    return points.filter((F.col("type") == tag) & _OPERATORS[op](F.col(VALUE_COLUMNS[tag]), F.lit(literal)))


def ts_double(ns: Column) -> Column:
    return ns.cast("double")
