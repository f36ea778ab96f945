"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mendwell.plans import cases, reports


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**cases.case_queries(), **reports.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**cases.case_oracles(), **reports.ORACLES}
