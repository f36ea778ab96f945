"""Registered queries against their SQL at the smallest scale.

`check.py` compares all of them at any scale; here it is the detectors, which
contain their injections, and some of each other kind.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from mendwell.plans.trade import SOURCE_TABLES

NAMES = sorted(name for name in entry.queries() if name.startswith("detect_")) + [
    "table_fingerprints", "profile_report", "fault_journal", "clean_controls", "repeated_documents", "quality_before_after",
    "verification_of_states", "similar_customer_names", "resolved_customers", "published_versions", "row_changes", "cell_changes", "distinct_counts",
    "cleaning_report", "inject_line_price", "inject_case_noise", "inject_corrupted_key", "repair_outlier", "repair_corrupted_key", "surface_scenario",
]


@pytest.fixture(scope="module")
def sql(tiny):
    con = duckdb.connect()
    for name in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tiny, sql, name):
    df = entry.queries()[name](spark, tiny)
    want = sql.execute(entry.oracle_sql()[name])
    columns = [item[0] for item in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(row) for row in df.collect()]) == rows_of(columns, want.fetchall())


def test_the_flagship_query_runs(spark):
    rows = {row["stage"]: row for row in entry.entry(spark).collect()}
    assert rows["raw"]["quality_score"] == 50.0 and rows["clean"]["quality_score"] == 100.0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
