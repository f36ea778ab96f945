"""Score a dataset against a fault journal and clean controls, cell by cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.functions.text import canonical_value, key_token
from mendwell.session import cut_all, meet, small_side
from mendwell.spec import Dataset, TableSpec


def _current_rows(
    df: DataFrame, spec: TableSpec, wanted: DataFrame, columns: Sequence[str], bound: int
) -> DataFrame:
    """Rows of the table that the ``wanted`` keys point at, cells as a map of text.

    The table meets the keys in a semi join first, and of a large table only
    the rows in question move.
    """
    types = {field.name: field.dataType for field in df.schema.fields}
    entries = [part for name in columns for part in (F.lit(name), canonical_value(F.col(name), types[name]))]
    cells = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    rows = df.select(key_token(spec.primary_key).alias("_token"), *columns)
    keys = wanted.select(F.col("key").alias("_token"))
    return meet(rows, keys, ["_token"], "left_semi", bound).select("_token", cells.alias("_cells"))


def _by_table(records: DataFrame) -> dict[str, tuple[list[str], int]]:
    """Columns per table, a few names, bounded by the schema, and how many keys its records name."""
    keys = F.count("primary_key") + F.count("corrupted_primary_key")
    found = records.groupBy("table").agg(F.collect_set("column").alias("columns"), keys.alias("n")).collect()
    return {row["table"]: (sorted(row["columns"]), row["n"]) for row in sorted(found)}


def current_cells(dataset: Dataset, records: DataFrame) -> DataFrame:
    """Records with ``row_exists`` and ``current_value`` as the dataset has them.

    A row is looked up by its key and, failing that, by its corrupted key. A
    table is read once, side by side with the others; what the records point
    at, at most a row a key, is kept for the lookups.
    """
    if "corrupted_primary_key" not in records.columns:
        records = records.withColumn("corrupted_primary_key", F.lit(None).cast("string"))
    parts, tables = [], _by_table(records)
    found = {}
    for table, (columns, count) in tables.items():
        here = records.filter(F.col("table") == table)
        wanted = here.select(F.explode(F.array("primary_key", "corrupted_primary_key")).alias("key")).na.drop()
        found[table] = _current_rows(dataset[table], dataset.specs[table], wanted, columns, count)
    found = cut_all(found)
    for table, (columns, count) in tables.items():
        here, rows = records.filter(F.col("table") == table), found[table]
        by_key = rows.select(F.col("_token").alias("primary_key"), F.col("_cells").alias("_by_key"))
        by_moved = rows.select(F.col("_token").alias("corrupted_primary_key"), F.col("_cells").alias("_by_moved"))
        moved = here.filter(F.col("corrupted_primary_key").isNotNull())
        straight = here.filter(F.col("corrupted_primary_key").isNull()).withColumn(
            "_by_moved", F.lit(None).cast("map<string,string>")
        )
        # Keys are unique, so no more rows come back than keys went out.
        straight = straight.join(small_side(by_key, count), "primary_key", "left")
        detour = moved.join(small_side(by_key, count), "primary_key", "left").join(
            small_side(by_moved, count), "corrupted_primary_key", "left"
        )
        parts.append(straight.unionByName(detour))
    if not parts:
        return records.withColumns({"row_exists": F.lit(False), "current_value": F.lit(None).cast("string")})
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    cells = F.coalesce("_by_key", "_by_moved")
    return out.withColumns({
        "row_exists": cells.isNotNull(),
        "current_value": F.try_element_at(cells, F.col("column")),
    }).drop("_by_key", "_by_moved")


def _as_wanted() -> Column:
    """An inserted row is gone; any other is there with the clean value (NULL equals NULL)."""
    clean = F.col("current_value").eqNullSafe(F.col("clean_value"))
    return F.when(F.col("operation") == "insert_row", ~F.col("row_exists")).otherwise(F.col("row_exists") & clean)


def fault_outcomes(dataset: Dataset, journal: DataFrame) -> DataFrame:
    """Each journal record with ``repaired``."""
    return current_cells(dataset, journal).withColumn("repaired", _as_wanted())


def control_outcomes(dataset: Dataset, controls: DataFrame) -> DataFrame:
    """Each control with ``preserved``."""
    clean = F.col("current_value").eqNullSafe(F.col("clean_value"))
    return current_cells(dataset, controls).withColumn("preserved", F.col("row_exists") & clean)


def count_unresolved(dataset: Dataset, journal: DataFrame) -> int:
    return fault_outcomes(dataset, journal).filter(~F.col("repaired")).count()


def percent(part: Column, whole: Column) -> Column:
    """Percentage to four digits; 100 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 4)).otherwise(F.lit(100.0))


def _fault_counts() -> list[Column]:
    update = F.col("operation") == "update_cell"
    return [
        F.count_if("repaired").alias("repaired_faults"),
        F.count_if(~F.col("repaired")).alias("remaining_faults"),
        F.count_if(update & ~F.col("row_exists")).alias("missing_rows"),
    ]


def quality(dataset: Dataset, journal: DataFrame, controls: DataFrame) -> DataFrame:
    """One row: quality, repair accuracy, control preservation and their counts.

    Faults and controls are looked up together.
    """
    names = ["table", "primary_key", "column", "clean_value"]
    moved = F.col("corrupted_primary_key") if "corrupted_primary_key" in journal.columns else F.lit(None).cast("string")
    faults = journal.select(*names, "operation", moved.alias("corrupted_primary_key"))
    found = current_cells(dataset, faults.unionByName(controls.select(*names), allowMissingColumns=True))
    update, control = F.col("operation").isNotNull(), F.col("operation").isNull()
    counts = found.select(
        "operation", "row_exists", F.when(update, _as_wanted()).alias("repaired"), F.when(control, _as_wanted()).alias("preserved")
    ).agg(
        *_fault_counts(),
        F.count_if("preserved").alias("preserved_controls"),
        F.count_if(~F.col("preserved")).alias("false_positives"),
    )
    repaired, remaining = F.col("repaired_faults"), F.col("remaining_faults")
    preserved, harmed = F.col("preserved_controls"), F.col("false_positives")
    return counts.select(
        percent(repaired + preserved, repaired + remaining + preserved + harmed).alias("quality_score"),
        percent(repaired, repaired + remaining).alias("repair_accuracy"),
        percent(preserved, preserved + harmed).alias("control_preservation"),
        "repaired_faults", "remaining_faults", "preserved_controls", "false_positives", "missing_rows",
    )


def quality_by(dataset: Dataset, journal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repair accuracy per rule, error type or any other journal columns."""
    counts = fault_outcomes(dataset, journal).groupBy(*keys).agg(*_fault_counts())
    return counts.withColumn(
        "repair_accuracy",
        percent(F.col("repaired_faults"), F.col("repaired_faults") + F.col("remaining_faults")),
    )


def gate(score: DataFrame, violations: DataFrame, comparison: DataFrame) -> DataFrame:
    """One row with ``passed``: full quality, nothing left, nothing harmed, no
    constraint broken and every table as expected.

    ``violations`` has a count ``violations`` per constraint, ``comparison`` a
    flag ``match`` per table.
    """
    broken = violations.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))
    tables = comparison.agg(F.count_if("match").alias("matching_tables"), F.count("*").alias("table_count"))
    side_by_side = score.unionByName(broken, allowMissingColumns=True).unionByName(tables, allowMissingColumns=True)
    return side_by_side.agg(*[F.max(name).alias(name) for name in side_by_side.columns]).withColumn(
        "passed",
        (F.col("quality_score") == 100.0)
        & (F.col("remaining_faults") == 0)
        & (F.col("false_positives") == 0)
        & (F.col("violations") == 0)
        & (F.col("matching_tables") == F.col("table_count")),
    )


def summary(results: Mapping[str, DataFrame | None], expected: Sequence[str] | None = None) -> DataFrame:
    """Gate results of several scenarios as rows, with ``complete`` and ``all_passed``.

    ``expected`` names the scenarios that a whole verification has (those of ``results``, if
    none are given). One without a result, or with an empty one, is not complete; then nothing as a whole has passed.
    """
    names = list(dict.fromkeys([*(results if expected is None else expected), *results]))
    made = {name: df for name, df in results.items() if df is not None}
    if not made:
        raise ValueError("no scenario has a result")
    spark = next(iter(made.values())).sparkSession
    columns = [name for name in next(iter(made.values())).columns if name != "scenario"]
    gates = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("scenario"), *columns) for name, df in made.items()])
    wanted = spark.createDataFrame([(no, name) for no, name in enumerate(names)], "scenario_no int, scenario string")
    rows = F.broadcast(wanted).join(gates, "scenario", "left").withColumns({
        "complete": F.col("passed").isNotNull(), "passed": F.coalesce("passed", F.lit(False)),
    })
    return rows.withColumn("all_passed", F.every("passed").over(Window.partitionBy())).drop("scenario_no")  # a row per scenario


def build_report(
    raw: DataFrame, clean: DataFrame, comparison: DataFrame, statistics: DataFrame, profile: DataFrame
) -> DataFrame:
    """The record of a build as rows of (part, item, value): scores before and after
    the repair, tables against the baseline, assertions per rule, full profile."""

    def part(df: DataFrame, name: str, item: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("part"), item.alias("item"), value.cast("string").alias("value"))

    quality = F.col("quality_score").cast("double")
    place = F.concat("table", F.coalesce(F.concat(F.lit("."), "column"), F.lit("")), F.lit(" "), "metric")
    return (
        part(raw, "raw score", F.lit("quality_score"), quality)
        .unionByName(part(clean, "clean score", F.lit("quality_score"), quality))
        .unionByName(part(comparison, "comparison", F.col("table"), F.col("match")))
        .unionByName(part(statistics, "rule", F.col("rule_id"), F.col("generated_assertions")))
        .unionByName(part(profile, "profile", place, F.col("value")))
    )
