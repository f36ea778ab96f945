"""Row-local repairs: the clean value computed from the raw one.

A fix returns NULL where it cannot tell the clean value, never a guess.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwell.functions.checks import HIDDEN_CHARACTERS

# Country spellings found in raw data and the names they stand for.
COUNTRY_NAMES = {
    "México": "Mexico", "United Kingdom": "UK", "sweden": "Sweden",
    "DE": "Germany", "FRANCE ": "France", "España": "Spain",
    "CA": "Canada", "switzerland": "Switzerland", "austria": "Austria",
    "Brasil": "Brazil", "U.S.A.": "USA", "Venez.": "Venezuela",
    "belgium": "Belgium", "portugal": "Portugal", "argentina": "Argentina",
    "italy": "Italy", "norway": "Norway", "denmark": "Denmark",
    "finland": "Finland", "poland": "Poland",
}


def parse_currency(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9,.\-]", "")
    return F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")


def parse_percent(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "%$", "").try_cast("double") / 100


def normalize_date(value: Column, label: Column | None = None) -> Column:
    """ISO text of a date written day first, month first or year first.

    Two of the three spellings drop the seconds. With a label they are taken
    from it, and only if the part that was kept agrees; without one they are
    taken as zero. A label that holds only a date keeps the result a date.
    """
    rest = r" ([0-9]{2}:[0-9]{2})"
    day_first, month_first = r"^([0-9]{2})/([0-9]{2})/([0-9]{4})" + rest + "$", (
        r"^([0-9]{2})-([0-9]{2})-([0-9]{4})" + rest + ":([0-9]{2})$"
    )
    year_first = r"^([0-9]{4})/([0-9]{2})/([0-9]{2})" + rest + "$"
    lost = value.rlike(day_first) | value.rlike(year_first)
    iso = (
        F.when(value.rlike(day_first), F.regexp_replace(value, day_first, "$3-$2-$1 $4:00"))
        .when(value.rlike(month_first), F.regexp_replace(value, month_first, "$3-$1-$2 $4:$5"))
        .when(value.rlike(year_first), F.regexp_replace(value, year_first, "$1-$2-$3 $4:00"))
        .otherwise(value)
    )
    full = F.substring(iso.try_cast("timestamp_ntz").cast("string"), 1, 19)
    if label is None:
        return full
    kept = F.substring(full, 1, 16)
    agrees = (label == F.substring(full, 1, 10)) | F.startswith(label, kept)
    exact = F.when(F.contains(label, F.lit(" ")), full).otherwise(F.substring(full, 1, 10))
    return F.when(lost, F.when(agrees, label)).otherwise(exact)


def collapse_whitespace(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def canonical_case(value: Column, canonical: Column) -> Column:
    return F.when(F.lower(value) == F.lower(canonical), canonical)


def canonical_alias(value: Column, names: Mapping[str, str] = COUNTRY_NAMES) -> Column:
    pairs = [F.lit(word) for pair in names.items() for word in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def undo_factor(value: Column, factor: int = 100) -> Column:
    """An integer of up to 28 digits divided by the factor, only where it divides evenly; no digit is lost."""
    number = value.try_cast("decimal(38,10)")
    return F.when((number % factor) == 0, (number / factor).cast("decimal(38,0)"))


def absolute(value: Column) -> Column:
    """In the type of a numeric column, so that no digit is lost; text is read as a double."""
    return F.when(value.try_cast("double").isNotNull(), F.abs(value))


def percentage_to_fraction(value: Column) -> Column:
    fraction = F.round(value.try_cast("double") / 100, 10)
    return F.when(fraction.between(0, 1), fraction)


def _nfkc(value: Column) -> Column:
    # A local function travels by value, so workers need not have this package.
    @F.pandas_udf(T.StringType())
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: unicodedata.normalize("NFKC", text), na_action="ignore")

    return compose(value)


def remove_hidden(value: Column) -> Column:
    """NFKC form without zero-width characters.

    ASCII text is its own NFKC form, so only other texts travel to Python.
    """
    composed = F.coalesce(_nfkc(F.when(value.rlike(r"[^\x00-\x7f]"), value)), value)
    return F.translate(composed, HIDDEN_CHARACTERS, "")


def undo_day_shift(value: Column, days: int = 365, label: Column | None = None) -> Column:
    """ISO text moved back; date-only where the label is date-only."""
    moved = value.try_cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    full = F.substring(moved.cast("string"), 1, 19)
    if label is None:
        return full
    return F.when(F.contains(label, F.lit(" ")), full).otherwise(F.substring(full, 1, 10))


def undo_scale(value: Column, factor: int = 100, digits: int = 10) -> Column:
    """``digits`` after the point must stay within what a double resolves."""
    return F.round(value.try_cast("double") * factor, digits)
