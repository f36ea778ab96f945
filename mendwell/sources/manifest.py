"""Manifests: the plan, journal, controls and expectations of a dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwell.operators.compare import fingerprints
from mendwell.spec import Dataset

@dataclass
class Manifest:
    plan: DataFrame
    journal: DataFrame
    controls: DataFrame
    expectations: DataFrame
    raw_prints: DataFrame


def records_for(journal: DataFrame, rule_id: str) -> DataFrame:
    """Journal records of one rule; a partition filter on a stored manifest."""
    return journal.filter(F.col("rule_id") == rule_id)


def expectations_of(dataset: Dataset) -> DataFrame:
    """Rows and fingerprint each table must have."""
    return fingerprints(dataset)


def write_manifest(manifest: Manifest, path: str) -> None:
    """Store a manifest as Parquet; the journal is partitioned by rule."""
    root = path.rstrip("/")
    manifest.plan.write.parquet(f"{root}/plan")
    manifest.journal.write.partitionBy("rule_id").parquet(f"{root}/journal")
    manifest.controls.write.parquet(f"{root}/controls")
    manifest.expectations.write.parquet(f"{root}/expectations")
    manifest.raw_prints.write.parquet(f"{root}/raw_prints")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    root = path.rstrip("/")
    return Manifest(*[
        spark.read.parquet(f"{root}/{part}") for part in ("plan", "journal", "controls", "expectations", "raw_prints")
    ])


_KEY = "map<string,string>"
_DOCUMENT = f"""
    preprocessing_plan array<struct<
        rule_id string, location struct<table string, columns array<string>>, error_type string,
        preprocessing struct<expected_action string>, affected_assertions bigint>>,
    repair_records array<struct<
        operation_id string, operation string, rule_id string, table string, primary_key {_KEY}, column string,
        clean_value string, corrupted_value string, error_type string, severity string, expected_action string,
        recoverability string, corrupted_primary_key {_KEY}>>,
    clean_controls array<struct<
        control_id string, table string, primary_key {_KEY}, column string, clean_value string>>,
    validation_expectations struct<tables {_KEY.replace('string>', 'struct<rows bigint, fingerprint string>>')}>,
    execution_order array<string>
"""


@dataclass
class Document:
    plan: DataFrame
    journal: DataFrame
    controls: DataFrame
    expectations: DataFrame


def read_document(spark: SparkSession, path: str) -> Document:
    """A manifest kept as one JSON document, as DataFrames.

    One document is one task's work, so this is for exchange, not for storage.
    Keys are read as maps of text.
    """
    document = spark.read.schema(_DOCUMENT).option("multiLine", True).json(path)

    def rows(part: str) -> DataFrame:
        return document.select(F.inline(part))

    return Document(
        plan=rows("preprocessing_plan").select(
            "rule_id", "location.table", "location.columns", "error_type", "preprocessing.expected_action",
            "affected_assertions",
        ),
        journal=document.select(F.posexplode("repair_records").alias("_place", "r")).select(
            (F.col("_place") + 1).cast("bigint").alias("op_seq"), "r.*"
        ),
        controls=rows("clean_controls"),
        expectations=document.select(F.explode("validation_expectations.tables").alias("table", "e")).select(
            "table", "e.rows", "e.fingerprint"
        ),
    )
