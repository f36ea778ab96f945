"""Row-local checks: each is a Boolean expression that marks a suspect cell."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing value, and characters nobody sees.
MISSING_WORDS = ("n/a", "na", "unknown", "-", "")
HIDDEN_CHARACTERS = "\u200b\ufeff"


def text_in_number(value: Column) -> Column:
    return value.isNotNull() & value.try_cast("double").isNull()


def percent_text(value: Column) -> Column:
    return F.endswith(F.trim(value), F.lit("%")) & text_in_number(value)


def not_iso_date(value: Column) -> Column:
    return ~value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")


def missing_word(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*MISSING_WORDS)


def whitespace_noise(value: Column) -> Column:
    return (value != F.trim(value)) | F.contains(value, F.lit("  ")) | F.contains(value, F.lit("\t"))


def single_case(value: Column) -> Column:
    return (value == F.upper(value)) | (value == F.lower(value))


def known_alias(value: Column, aliases: Iterable[str]) -> Column:
    return value.isin(*aliases)


def missing(value: Column) -> Column:
    return value.isNull()


def at_least(value: Column, threshold: float) -> Column:
    return value.try_cast("double") >= threshold


def below_domain(value: Column, limit: float = 0.0, strict: bool = True) -> Column:
    """Below the limit; with ``strict=False`` the limit itself is suspect too."""
    number = value.try_cast("double")
    return number < limit if strict else number <= limit


def outside_fraction(value: Column) -> Column:
    return ~value.try_cast("double").between(0, 1)


def hidden_unicode(value: Column) -> Column:
    return value != F.translate(value, HIDDEN_CHARACTERS, "")


def before(later: Column, earlier: Column) -> Column:
    return later < earlier
