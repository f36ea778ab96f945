"""Score recommendations (which rule, what to do) against the expected rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _signature() -> Column:
    return F.struct("table", F.array_sort("columns").alias("columns"), "error_type")


def match_recommendations(provided: DataFrame, expected: DataFrame) -> DataFrame:
    """Recommendations with ``matched_rule``: by rule id, else by table, columns
    (in any order) and error type."""
    by_id = expected.select(F.col("rule_id"), F.col("rule_id").alias("_by_id"))
    by_signature = expected.groupBy(_signature().alias("_signature")).agg(F.max("rule_id").alias("_by_signature"))
    return (
        provided.withColumn("_signature", _signature())
        .join(by_id, "rule_id", "left")
        .join(by_signature, "_signature", "left")
        .withColumn("matched_rule", F.coalesce("_by_id", "_by_signature"))
        .drop("_signature", "_by_id", "_by_signature")
    )


def score_recommendations(provided: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: detection precision and recall, and accuracy of the actions.

    Precision counts distinct matched rules over all recommendations, so a
    repeated recommendation lowers it.
    """
    matched = match_recommendations(provided, expected)
    wanted = expected.select(
        F.col("rule_id").alias("matched_rule"), F.lower(F.trim("expected_action")).alias("_wanted")
    )
    judged = matched.join(wanted, "matched_rule", "left")
    right = F.lower(F.trim("recommended_action")) == F.col("_wanted")
    both = judged.select("matched_rule", right.alias("right"), F.lit(1).alias("_given")).unionByName(
        expected.select(F.col("rule_id").alias("_rule")), allowMissingColumns=True
    )
    counts = both.agg(
        F.count("_given").alias("provided"),
        F.count_distinct("_rule").alias("expected"),
        F.count_distinct("matched_rule").alias("matched"),
        F.count_distinct(F.when(F.col("right"), F.col("matched_rule"))).alias("_right"),
    )

    def rate(part: str, whole: str, of_nothing: float) -> Column:
        share = F.round(F.col(part) / F.nullif(F.col(whole), F.lit(0)), 4)
        return F.coalesce(share, F.lit(of_nothing))

    return counts.select(
        "provided", "expected", "matched",
        rate("matched", "provided", 0.0).alias("detection_precision"),
        rate("matched", "expected", 1.0).alias("detection_recall"),
        rate("_right", "expected", 1.0).alias("action_accuracy"),
    )


def recommendation_lists(provided: DataFrame, expected: DataFrame) -> DataFrame:
    """Rules detected and missed and recommendations unknown, as sorted rows."""
    matched = match_recommendations(provided, expected)
    detected = matched.filter(F.col("matched_rule").isNotNull()).select(F.col("matched_rule").alias("name")).distinct()
    missed = expected.select(F.col("rule_id").alias("name")).join(detected, "name", "left_anti")
    unknown = matched.filter(F.col("matched_rule").isNull()).select(
        F.coalesce("rule_id", F.concat(F.lit("response-item-"), F.col("item_no"))).alias("name")
    )
    return (
        detected.select(F.lit("detected").alias("list"), "name")
        .unionByName(missed.select(F.lit("missed").alias("list"), "name"))
        .unionByName(unknown.select(F.lit("unknown").alias("list"), "name"))
        .orderBy("list", "name")
    )
