"""Turns of conversations as the operators on them see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn_name(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn, in hex; equal for equal roles and texts only."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)


def named_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``name``, ``role``, ``text``: null roles and texts become empty.

    Turns are ordered by ``turn``, null first; those of equal number by ``name``.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return turns.select("conv_id", "turn", turn_name(role, text).alias("name"), role.alias("role"), text.alias("text"))
