"""Cell transforms that put a fault into a value.

Each takes the column as it is now, the row's place in the sample where the
fault cycles through variants, and the rule's parameters. All are plain column
expressions, so a rule costs one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwell.functions.text import ISO_SECONDS, plain_number

# Spellings, formats and defaults that faults are made of.
PLACEHOLDERS = ("N/A", "unknown", "-")
COUNTRY_ALIASES = {
    "USA": "U.S.A.", "UK": "United Kingdom", "Germany": "DE",
    "France": "FRANCE ", "Brazil": "Brasil", "Mexico": "México",
    "Venezuela": "Venez.", "Spain": "España", "Canada": "CA",
}
ZERO_WIDTH_SPACE = "\u200b"

# Transforms whose result depends on the row's place in the sample.
CYCLIC = frozenset({"placeholder", "case_noise", "date_format"})
# Transforms whose result is text whatever the column's type is.
TEXT_MAKING = frozenset({
    "placeholder", "pad_whitespace", "case_noise", "date_format", "prefixed_numeric",
    "percent_string", "country_alias", "zero_width", "typo",
})


def iso_text(value: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' of a timestamp or of ISO text, free of time zones."""
    stamp = value.try_cast("timestamp_ntz")
    return F.substring(stamp.cast("string"), 1, ISO_SECONDS)


def _number(value: Column) -> Column:
    return value.try_cast("double")


def make_null(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    return F.lit(None)


def placeholder(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    choices = list(params.get("values", PLACEHOLDERS))
    return F.element_at(F.array(*[F.lit(text) for text in choices]), (index % len(choices) + 1).cast("int"))


def pad_whitespace(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    return F.concat(F.lit("  "), F.replace(value.cast("string"), F.lit(" "), F.lit("  ")), F.lit("   "))


def case_noise(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    text = value.cast("string")
    return F.when(index % 2 == 0, F.lower(text)).otherwise(F.upper(text))


def date_format(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    """Day first, month first, or year first with slashes; two of them lose seconds."""
    iso = iso_text(value)
    year, month, day = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
    minutes, seconds = F.substring(iso, 12, 5), F.substring(iso, 12, 8)
    return (
        F.when(index % 3 == 0, F.concat(day, F.lit("/"), month, F.lit("/"), year, F.lit(" "), minutes))
        .when(index % 3 == 1, F.concat(month, F.lit("-"), day, F.lit("-"), year, F.lit(" "), seconds))
        .otherwise(F.concat(year, F.lit("/"), month, F.lit("/"), day, F.lit(" "), minutes))
    )


def prefixed_numeric(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    return F.concat(F.lit(params.get("prefix", "USD ")), value.cast("string"))


def _own_arithmetic(name: str, value: Column, dtype: T.DataType, params: Mapping[str, Any]) -> Column | None:
    """Sum or product without a detour over doubles, where type and parameter are exact; a result
    that 64 bits cannot hold is an error."""
    given = Decimal(str(params.get(*{"multiply": ("factor", 100), "add": ("increment", 100_000)}[name])))
    whole = isinstance(dtype, T.IntegralType) and given == given.to_integral_value()
    if not whole and not isinstance(dtype, T.DecimalType):
        return None
    number, other = (value.cast("bigint"), F.lit(int(given)).cast("bigint")) if whole else (value, F.lit(given))
    if not whole:
        return number * other if name == "multiply" else number + other
    made = F.try_multiply(number, other) if name == "multiply" else F.try_add(number, other)
    return F.when(value.isNotNull(), F.coalesce(made, F.raise_error(F.lit(f"{name}: beyond 64 bits")).cast("bigint")))


def multiply(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    return _number(value) * F.lit(float(params.get("factor", 100)))


def add(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    return _number(value) + F.lit(float(params.get("increment", 100_000)))


def scale(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    return _number(value) * F.lit(float(params.get("factor", 0.01)))


def percent_string(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    return F.concat(plain_number(_number(value) * 100), F.lit("%"))


def country_alias(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    aliases = params.get("aliases", COUNTRY_ALIASES)
    pairs = [F.lit(word) for pair in aliases.items() for word in pair]
    text = value.cast("string")
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), F.lower(text))


def negative(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    # By text: a minus sign on a long decimal would round it to 34 digits.
    return F.when(value == 0, F.lit("-1")).otherwise(F.concat(F.lit("-"), F.abs(value).cast("string")))


def date_before(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    source = F.col(params["source_column"]).try_cast("timestamp_ntz")
    return source - F.make_dt_interval(F.lit(int(params.get("days", 30))))


def date_shift(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    return value.try_cast("timestamp_ntz") + F.make_dt_interval(F.lit(int(params.get("days", 365))))


def invalid_fk(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    return F.lit(params["value"])


def zero_width(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    text = value.cast("string")
    place = F.greatest(F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    return F.concat(
        F.substring(text, F.lit(1), place), F.lit(ZERO_WIDTH_SPACE), F.substring(text, place + 1, F.length(text))
    )


def swap_middle(text: Column) -> Column:
    """The text with the two characters around its middle exchanged."""
    size = F.length(text)
    place = F.greatest(F.lit(0), F.least(size - 2, F.floor(size / 2).cast("int") - 1))
    return F.concat(
        F.substring(text, F.lit(1), place),
        F.substring(text, place + 2, F.lit(1)),
        F.substring(text, place + 1, F.lit(1)),
        F.substring(text, place + 3, size),
    )


def typo(value: Column, index: Column, params: Mapping[str, Any]) -> Column:
    text = value.cast("string")
    swapped = swap_middle(text)
    return F.when((F.length(text) < 2) | (swapped == text), F.concat(text, F.lit("?"))).otherwise(swapped)


CELL_FAULTS: dict[str, Callable[[Column, Column, Mapping[str, Any]], Column]] = {
    "null": make_null,
    "placeholder": placeholder,
    "pad_whitespace": pad_whitespace,
    "case_noise": case_noise,
    "date_format": date_format,
    "prefixed_numeric": prefixed_numeric,
    "multiply": multiply,
    "add": add,
    "scale": scale,
    "percent_string": percent_string,
    "country_alias": country_alias,
    "negative": negative,
    "date_before": date_before,
    "date_shift": date_shift,
    "invalid_fk": invalid_fk,
    "zero_width": zero_width,
    "typo": typo,
}


def faulty(name: str, value: Column, dtype: T.DataType, index: Column, params: Mapping[str, Any]) -> Column:
    """The faulty value in the column's own type."""
    if name == "negative" and not isinstance(dtype, T.NumericType):
        value = _number(value)
    own = _own_arithmetic(name, value, dtype, params) if name in {"multiply", "add"} else None
    result = CELL_FAULTS[name](value, index, params) if own is None else own
    if isinstance(dtype, T.StringType) and name in {"date_before", "date_shift"}:
        return iso_text(result)
    return result.cast(dtype)
