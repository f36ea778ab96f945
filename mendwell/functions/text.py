"""Canonical text of values, rows and keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_SECONDS = 19  # length of 'yyyy-MM-dd HH:mm:ss'


def canonical_value(column: Column, dtype: T.DataType) -> Column:
    """One text per value. Binary becomes its hash and length, never raw bytes."""
    if isinstance(dtype, T.BinaryType):
        return F.when(
            column.isNotNull(),
            F.to_json(F.struct(F.sha2(column, 256).alias("blob_sha256"), F.octet_length(column).alias("bytes"))),
        )
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(column.isNotNull(), F.to_json(column, {"ignoreNullFields": "false"}))
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        return (column + F.lit(0.0).cast(dtype)).cast("string")  # one text for 0.0 and -0.0
    return column.cast("string")


def canonical_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[Column]:
    fields = {field.name: field.dataType for field in df.schema.fields}
    return [
        canonical_value(F.col(name), fields[name]).alias(name)
        for name in (columns if columns is not None else df.columns)
    ]


def row_text(df: DataFrame) -> Column:
    """Compact JSON list of the row's canonical values; NULLs and Unicode kept."""
    return F.to_json(F.array(*canonical_columns(df)), {"ignoreNullFields": "false"})


def row_json(df: DataFrame) -> Column:
    """JSON object of the row's canonical values, for inserted rows."""
    return F.to_json(F.struct(*canonical_columns(df)), {"ignoreNullFields": "false"})


def key_token(columns: Sequence[str], values: Sequence[Column] | None = None) -> Column:
    """Canonical text of a key: a JSON object with its columns in sorted order."""
    values = [F.col(name) for name in columns] if values is None else values
    pairs = sorted(zip(columns, values), key=lambda pair: pair[0])
    return F.to_json(F.struct(*[value.alias(name) for name, value in pairs]), {"ignoreNullFields": "false"})


def key_match(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality of two keys."""
    condition = F.lit(True)
    for one, other in zip(left, right, strict=True):
        condition = condition & one.eqNullSafe(other)
    return condition


def plain_number(value: Column, digits: int = 6) -> Column:
    """A number as text of so many significant digits, without trailing zeros: 7.0 -> '7', 1.5e-9 -> '1.5e-09'."""
    written = F.format_string(f"%.{digits - 1}e", value.cast("double"))
    mantissa, exponent = F.substring_index(written, "e", 1), F.substring_index(written, "e", -1).cast("int")
    plain = written.cast("double").cast(T.DecimalType(38, digits + 4)).cast("string")
    short = F.regexp_replace(plain, r"\.?0+$", "")
    long = F.concat(F.regexp_replace(mantissa, r"\.?0+$", ""), F.lit("e"), F.substring_index(written, "e", -1))
    return F.when(value.isNotNull(), F.when(exponent.between(-4, digits - 1), short).otherwise(long))


def significant(value: Column, digits: int = 9) -> Column:
    """A number rounded to so many significant digits."""
    return F.format_string(f"%.{digits - 1}e", value.cast("double")).cast("double")


def storage_class(value: Column) -> Column:
    """What the text of a dirty column holds: null, integer, real or text."""
    return (
        F.when(value.isNull(), "null")
        .when(value.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(value.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"), "real")
        .otherwise("text")
    )
