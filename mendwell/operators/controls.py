"""Clean controls: untouched cells that a repair must leave alone."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendwell.functions.text import canonical_value, key_token
from mendwell.operators.sampling import below, draw_hash, find_cut, with_index
from mendwell.session import cut_lineage, meet, small_side
from mendwell.spec import ControlScope, Dataset, Scenario

CONTROL_SEED_STEP = 9173  # fixed value: distance of the controls' seed from the scenario's


def _used_cells(journal: DataFrame) -> DataFrame:
    """Per row with faults: the columns in use, and whether its key was corrupted."""
    return (
        journal.filter(F.col("operation") == "update_cell")
        .groupBy("table", "primary_key")
        .agg(
            F.collect_set("column").alias("_used"),  # bounded by the number of columns
            F.max(F.col("corrupted_primary_key").isNotNull()).alias("_locked"),
        )
    )


def _cells_in_scope(baseline: Dataset, scope: Sequence[ControlScope]) -> DataFrame:
    parts = []
    for item in scope:
        df = baseline[item.table]
        types = {field.name: field.dataType for field in df.schema.fields}
        cells = F.array(*[
            F.struct(F.lit(name).alias("column"), canonical_value(F.col(name), types[name]).alias("clean_value"))
            for name in item.columns
        ])
        key = key_token(baseline.specs[item.table].primary_key).alias("primary_key")
        parts.append(df.select(F.lit(item.table).alias("table"), key, F.inline(cells)))
    return reduce(DataFrame.unionByName, parts)


def _cells_below(baseline: Dataset, scenario: Scenario, span: float) -> DataFrame:
    """Cells in scope whose hash ``h`` lies in the first ``span`` of all hashes. A row becomes cells, and a value becomes text, only where one does."""
    parts = []
    for item in scenario.control_scope:
        df = baseline[item.table]
        types = {field.name: field.dataType for field in df.schema.fields}
        hashes = {
            f"_hash_{no}": draw_hash(
                scenario.seed + CONTROL_SEED_STEP, "controls", F.concat_ws("|", F.lit(item.table), "_token", F.lit(name)))
            for no, name in enumerate(item.columns)
        }
        hashed = df.withColumn("_token", key_token(baseline.specs[item.table].primary_key)).withColumns(hashes)
        near = {name: F.col(hashed_as) < below(span) for name, hashed_as in zip(item.columns, hashes)}
        cells = [
            F.when(near[name], F.struct(
                F.lit(name).alias("column"), canonical_value(F.col(name), types[name]).alias("clean_value"), F.col(hashed_as).alias("h")))
            for name, hashed_as in zip(item.columns, hashes)
        ]
        any_near = reduce(lambda one, other: one | other, near.values())
        parts.append(hashed.select(
            F.lit(item.table).alias("table"), F.col("_token").alias("primary_key"),
            F.inline(F.when(any_near, F.array_compact(F.array(*cells))))))
    return reduce(DataFrame.unionByName, parts)


def _free(cells: DataFrame, used: DataFrame, few: bool = False) -> DataFrame:
    """Cells that are not in use. Of a ``few`` all are shuffled where the used ones are many, so that they are sought out once."""
    taken = F.coalesce(F.col("_locked") | F.array_contains(F.col("_used"), F.col("column")), F.lit(False))
    on = ["table", "primary_key"]
    met = cells.join(small_side(used), on, "left") if few else meet(cells, used, on)
    return met.filter(~taken).drop("_used", "_locked")


def control_candidates(baseline: Dataset, scope: Sequence[ControlScope], journal: DataFrame) -> DataFrame:
    """Cells in scope that no fault has used.

    A row whose key was corrupted gives no control at all, as its cells cannot
    be found by the original key.
    """
    return _free(_cells_in_scope(baseline, scope), cut_lineage(_used_cells(journal)))


def controls_wanted(faults: int, target_quality: float) -> int:
    return int(round(faults * target_quality / (100.0 - target_quality)))


def draw_controls(baseline: Dataset, scenario: Scenario, journal: DataFrame, faults: int) -> DataFrame:
    """As many controls as bring the raw quality to the scenario's target.

    The free cells with the smallest hashes are taken. How many cells there are
    is known from row counts, so one pass over the tables keeps little more
    cells than are wanted, and only those meet the used ones. Should used
    cells leave too few, a wider band is kept.
    """
    wanted = controls_wanted(faults, scenario.target_quality_score)
    used = cut_lineage(_used_cells(journal))
    known = used.agg(F.sum(F.size("_used")).alias("cells"), F.count_if("_locked").alias("rows")).first()
    total = sum(baseline[item.table].count() * len(item.columns) for item in scenario.control_scope)
    widest = max((len(item.columns) for item in scenario.control_scope), default=0)
    free = max(total - (known["cells"] or 0) - (known["rows"] or 0) * widest, 1)
    span = (wanted + 12 * math.sqrt(wanted) + 64) / free
    while True:
        span = min(span, 1.0)
        near = cut_lineage(_free(_cells_below(baseline, scenario, span), used, few=span < 1.0))
        if span == 1.0 or near.count() >= wanted:
            break
        span *= 8
    cut = find_cut(near, count=wanted, what="clean controls", span=span)
    drawn = with_index(near.filter(cut.contains(F.col("h"))), ["table", "primary_key", "column"], "_place", wanted)
    return cut_lineage(drawn.select(
        F.concat(F.lit(f"{scenario.id}-CTRL-"), F.format_string("%06d", F.col("_place") + 1)).alias("control_id"),
        "table", "primary_key", "column", "clean_value",
    ))
