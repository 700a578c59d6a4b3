"""Canonical text for values and rows, so equal contents read equal whatever wrote them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole floats up to here are exact integers.
EXACT_INTEGER = 2**53

#: Control characters whose JSON escape contains a letter; written in lower case.
LETTERED_ESCAPES = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def number_text(x: Column) -> Column:
    """A double as JSON text: whole values as integers, the rest in the shortest notation."""
    raw = x.cast("string")
    size = F.abs(x)
    fixed = F.regexp_replace(raw.cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    mantissa = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(raw, F.lit("E"), F.lit(2)).cast("int")
    exponent = F.concat(
        mantissa,
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    return (
        F.when((F.floor(x) == x) & (size <= EXACT_INTEGER), x.cast("long").cast("string"))
        .when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), fixed)
        .otherwise(exponent)
    )


def string_text(s: Column) -> Column:
    """A string as JSON text; the escaping path runs only where something needs escaping."""
    quoted = F.to_json(F.array(s))
    escaped = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    for code in LETTERED_ESCAPES:
        escaped = F.regexp_replace(
            escaped, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}"
        )
    return F.when(s.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(F.concat(F.lit('"'), s, F.lit('"')))


def value_text(column: Column, kind: T.DataType, canonical: bool = True) -> Column:
    """One value as JSON text; with `canonical` off a whole double keeps its `.0`."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        wide = column.cast("double")
        text = number_text(wide)
        if not canonical:
            text = F.when(F.floor(wide) == wide, F.concat(text, F.lit(".0"))).otherwise(text)
    elif isinstance(kind, T.IntegralType | T.BooleanType | T.DecimalType):
        text = column.cast("string")
    elif isinstance(kind, T.ArrayType):
        element = kind.elementType
        inner = F.transform(column, lambda x: value_text(x, element, canonical))
        text = F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        text = string_text(column)
    else:
        text = string_text(column.cast("string"))
    return F.coalesce(text, F.lit("null"))


def row_repr(df: DataFrame, columns: Sequence[str], canonical: bool = True) -> Column:
    """A row as a JSON array of its values in declared order; names are left out."""
    kinds = {field.name: field.dataType for field in df.schema}
    parts = [value_text(F.col(name), kinds[name], canonical) for name in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def cell_key(column: Column, kind: T.DataType) -> Column:
    """One value as short unambiguous text for hashing.

    A number is its canonical digits, a string is its length and itself, so `217` the number,
    `217.0` the number and `217` the string read as equal, equal and different. Cheaper than JSON:
    nothing is escaped.
    """
    if isinstance(kind, T.DoubleType | T.FloatType):
        wide = column.cast("double")
        whole = (wide == F.floor(wide)) & (F.abs(wide) <= EXACT_INTEGER)
        text = F.when(whole, wide.cast("long").cast("string")).otherwise(wide.cast("string"))
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(column).cast("string")
    elif isinstance(kind, T.ArrayType):
        element = kind.elementType
        text = F.concat(
            F.lit("["), F.array_join(F.transform(column, lambda x: cell_key(x, element)), ","), F.lit("]")
        )
    elif isinstance(kind, T.StringType):
        text = F.concat(F.length(column).cast("string"), F.lit(":"), column)
    elif isinstance(kind, T.DecimalType):
        text = F.regexp_replace(F.regexp_replace(column.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif isinstance(kind, T.StructType | T.MapType):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("null"))


def row_key(df: DataFrame, columns: Sequence[str]) -> Column:
    kinds = {field.name: field.dataType for field in df.schema}
    return F.concat_ws(",", *[cell_key(F.col(name), kinds[name]) for name in columns])


def canonical_numbers(df: DataFrame) -> DataFrame:
    """Every double column in its canonical text form; other columns untouched."""
    return df.select(
        *[
            number_text(F.col(f.name).cast("double")).alias(f.name)
            if isinstance(f.dataType, T.DoubleType | T.FloatType)
            else F.col(f.name)
            for f in df.schema
        ]
    )
