"""Repairs: values computed from the raw ones, or labels put back.

A table is read once for any number of rules. Labels come to it as one row per
key, so however many cells they list, the table meets them in one join.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwell.functions.text import canonical_value, key_token
from mendwell.operators.groups import lookup
from mendwell.session import cut_lineage, meet, small_side
from mendwell.spec import Dataset, TableSpec


class RepairError(ValueError):
    """A repair disagrees with its labels or does not find its row."""


Fix = Callable[[Column, Column], Column]
"""A clean value from the raw one and the label (which a fix may ignore)."""


@dataclass(frozen=True)
class Step:
    """What to do about one rule.

    ``kind``: ``derive`` computes the value by ``fix`` and checks it against the
    label; ``restore`` takes the label; ``swap`` exchanges the two columns of
    the rule back; ``delete`` drops injected rows.
    """

    rule_id: str
    kind: str
    fix: Fix | None = None
    check: Column | None = None  # marks candidates, for the report
    columns: Sequence[str] = field(default=())


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {item.name: item.dataType for item in df.schema.fields}


def labels_by_row(labels: DataFrame) -> DataFrame:
    """One row per locator with its clean values by column.

    The locator is the corrupted key where the key itself was corrupted. A NULL
    label is a label too, so presence in the map counts, not the value. Entries
    per row are bounded by the number of columns.
    """
    return labels.filter(F.col("operation") == "update_cell").groupBy(
        F.coalesce("corrupted_primary_key", "primary_key").alias("_token")
    ).agg(F.map_from_entries(F.collect_list(F.struct("column", "clean_value"))).alias("_labels"))


def with_labels(df: DataFrame, spec: TableSpec, labels: DataFrame, records: int | None = None) -> DataFrame:
    """The table with a map ``_labels`` of clean values on the labelled rows.

    ``records`` is the number of labels, if it is known.
    """
    here = labels.filter(F.col("table") == spec.name)
    return meet(
        df.withColumn("_token", key_token(spec.primary_key)), labels_by_row(here), ["_token"], rows=records, keys=_locators(here)
    ).drop("_token")


def _locators(labels: DataFrame) -> DataFrame:
    return labels.select(F.coalesce("corrupted_primary_key", "primary_key").alias("_token"))


def _labelled(column: str) -> Column:
    return F.coalesce(F.map_contains_key("_labels", F.lit(column)), F.lit(False))


def _label(column: str) -> Column:
    return F.try_element_at("_labels", F.lit(column))


def restore_labels(
    df: DataFrame, spec: TableSpec, labels: DataFrame, columns: Sequence[str], records: int | None = None
) -> DataFrame:
    """Set labelled cells to their labels; also cells of the key itself."""
    types = _types(df)
    marked = with_labels(df, spec, labels, records)
    return marked.withColumns({
        column: F.when(_labelled(column), _label(column).cast(types[column])).otherwise(F.col(column))
        for column in columns
    }).drop("_labels")


def derive(df: DataFrame, spec: TableSpec, labels: DataFrame, fixes: Mapping[str, Fix]) -> DataFrame:
    """Compute labelled cells from their raw values (labels say which cells)."""
    types = _types(df)
    marked = with_labels(df, spec, labels)
    return marked.withColumns({
        column: F.when(_labelled(column), fix(F.col(column), _label(column)).cast(types[column])).otherwise(F.col(column))
        for column, fix in fixes.items()
    }).drop("_labels")


def derive_where(df: DataFrame, column: str, check: Column, fixed: Column) -> DataFrame:
    """Compute cells that a check marks, without labels: one projection."""
    return df.withColumn(column, F.when(check, fixed.cast(_types(df)[column])).otherwise(F.col(column)))


def label_disagreements(df: DataFrame, spec: TableSpec, labels: DataFrame, column: str, fix: Fix) -> DataFrame:
    """Labelled cells whose computed value is not the label."""
    dtype = _types(df)[column]
    marked = with_labels(df, spec, labels).filter(_labelled(column))
    derived = canonical_value(fix(F.col(column), _label(column)).cast(dtype), dtype)
    wanted = canonical_value(_label(column).cast(dtype), dtype)
    return marked.filter(~derived.eqNullSafe(wanted)).select(
        key_token(spec.primary_key).alias("primary_key"),
        F.col(column).cast("string").alias("raw_value"),
        derived.alias("derived_value"),
        wanted.alias("label"),
    )


def reverse_swap(df: DataFrame, spec: TableSpec, labels: DataFrame, first: str, second: str) -> DataFrame:
    """Exchange two columns back, both at once, on each labelled row."""
    types = _types(df)
    hit = _labelled(first) | _labelled(second)
    return with_labels(df, spec, labels).withColumns({
        first: F.when(hit, F.col(second).cast(types[first])).otherwise(F.col(first)),
        second: F.when(hit, F.col(first).cast(types[second])).otherwise(F.col(second)),
    }).drop("_labels")


def delete_inserted(df: DataFrame, spec: TableSpec, labels: DataFrame, records: int | None = None) -> DataFrame:
    """Drop exactly the rows recorded as inserted, never look-alikes."""
    keys = (
        labels.filter((F.col("table") == spec.name) & (F.col("operation") == "insert_row"))
        .select(F.col("primary_key").alias("_token"))
        .distinct()
    )
    return meet(df.withColumn("_token", key_token(spec.primary_key)), keys, ["_token"], "left_anti", records).drop("_token")


def canonical_by_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame, word: str) -> DataFrame:
    """Give each value the spelling its vocabulary uses, case aside."""
    spelled = vocabulary.groupBy(F.lower(F.col(word)).alias("folded")).agg(F.min(word).alias("spelling"))
    folded = df.withColumn("_folded", F.lower(F.col(column)))
    joined = lookup(folded, spelled, {"_folded": "folded"}, {"_spelling": "spelling"})
    return joined.withColumn(column, F.coalesce(F.col("_spelling"), F.col(column))).drop("_folded", "_spelling")


@dataclass(frozen=True)
class _Shape:
    rules: frozenset[str]
    updates: int
    inserts: int
    moved: int


def _shape(journal: DataFrame) -> dict[str, _Shape]:
    """Rules of each table and how many records they have: a row per table."""
    inserted = F.col("operation") == "insert_row"
    rows = journal.groupBy("table").agg(
        F.collect_set("rule_id").alias("rules"),
        F.count_if(~inserted).alias("updates"),
        F.count_if(inserted).alias("inserts"),
        F.count("corrupted_primary_key").alias("moved"),
    ).collect()
    return {row["table"]: _Shape(frozenset(row["rules"]), row["updates"], row["inserts"], row["moved"]) for row in sorted(rows)}


def wrong_match_counts(df: DataFrame, spec: TableSpec, labels: DataFrame) -> DataFrame:
    """Label locators that match no row, or more than one."""
    here = labels.filter((F.col("table") == spec.name) & (F.col("operation") == "update_cell"))
    wanted = _locators(here).distinct()
    rows = df.select(key_token(spec.primary_key).alias("_token"))
    matched = (
        meet(rows, wanted, ["_token"], "left_semi").groupBy("_token").agg(F.count("*").alias("matching_rows"))
    )
    return (
        wanted.join(matched, "_token", "left")
        .select(F.col("_token").alias("primary_key"), F.coalesce("matching_rows", F.lit(0)).alias("matching_rows"))
        .filter("matching_rows <> 1")
    )


def undo_journal(dataset: Dataset, journal: DataFrame) -> Dataset:
    """Take back all faults: drop inserted rows, restore every cell.

    Of several records of one cell the earliest holds the clean value, so the
    journal needs no replay in reverse order.
    """
    earliest = (
        journal.filter(F.col("operation") == "update_cell")
        .groupBy("table", "primary_key", "column")
        .agg(
            F.min_by("clean_value", "op_seq").alias("clean_value"),
            F.max("corrupted_primary_key").alias("corrupted_primary_key"),
            F.lit("update_cell").alias("operation"),
        )
    )
    touched = {
        row["table"]: row["columns"]
        for row in earliest.groupBy("table").agg(F.collect_set("column").alias("columns")).collect()
    }
    out = {}
    for table, shape in _shape(journal).items():
        spec = dataset.specs[table]
        df = dataset[table]
        if shape.inserts:
            df = delete_inserted(df, spec, journal, shape.inserts)
        here = earliest.filter(F.col("table") == table)
        here = _relocated(here, shape.moved) if shape.moved else here
        out[table] = restore_labels(df, spec, here, sorted(touched.get(table, [])), shape.updates)
    return dataset.with_tables(out)


def _relocated(records: DataFrame, rows: int) -> DataFrame:
    """A corrupted key moves all labels of its row to the corrupted locator; at most ``rows`` have one."""
    moved = records.groupBy("primary_key").agg(F.max("corrupted_primary_key").alias("_moved")).na.drop("any")
    return (
        records.join(small_side(moved, rows), "primary_key", "left")
        .withColumn("corrupted_primary_key", F.coalesce("corrupted_primary_key", "_moved"))
        .drop("_moved")
    )


def apply_step(df: DataFrame, spec: TableSpec, labels: DataFrame, step: Step) -> DataFrame:
    """The table after one step; ``labels`` are the records of its rule."""
    if step.kind == "delete":
        return delete_inserted(df, spec, labels)
    if step.kind == "swap":
        return reverse_swap(df, spec, labels, *step.columns)
    if step.kind == "derive":
        return derive(df, spec, labels, {column: step.fix for column in step.columns})
    if step.kind == "restore":
        return restore_labels(df, spec, labels, step.columns)
    raise ValueError(f"unknown kind of step: {step.kind}")


@dataclass
class Repaired:
    dataset: Dataset
    report: DataFrame


# Between a rule and its column in the labels of a row.
_SLOT = "\x1f"


def _slotted(df: DataFrame, spec: TableSpec, labels: DataFrame, records: int) -> DataFrame:
    """The table with a map ``_labels`` of clean values by rule and column; an inserted row has its rule alone."""
    rows = labels.select(
        F.coalesce("corrupted_primary_key", "primary_key").alias("_token"),
        F.concat("rule_id", F.lit(_SLOT), F.coalesce("column", F.lit(""))).alias("slot"), "clean_value",
    ).groupBy("_token").agg(F.map_from_entries(F.collect_list(F.struct("slot", "clean_value"))).alias("_labels"))
    return meet(df.withColumn("_token", key_token(spec.primary_key)), rows, ["_token"], rows=records, keys=_locators(labels))


class _Pass:
    """All steps of a table as one projection, and what is counted on the way."""

    def __init__(self, df: DataFrame, spec: TableSpec):
        self.df, self.spec = df.withColumn("_alive", F.lit(True)), spec
        self.types, self.metrics = _types(df), {}

    def _keep(self, values: dict[str, Column]) -> None:
        self.df = self.df.withColumns(values)

    def _count(self, name: str, condition: Column) -> None:
        column = f"_m{len(self.metrics)}"
        self._keep({column: F.col("_alive") & F.coalesce(condition, F.lit(False))})
        self.metrics[name] = F.count_if(column)

    def _text(self, value: Column, column: str) -> Column:
        return canonical_value(value.cast(self.types[column]), self.types[column])

    def add(self, number: int, step: Step) -> None:
        """The state before the step is counted, then the step is taken, then its cells are counted again."""
        slots = {column: F.lit(f"{step.rule_id}{_SLOT}{column}") for column in step.columns}
        here = {column: F.coalesce(F.map_contains_key("_labels", slot), F.lit(False)) for column, slot in slots.items()}
        label = {column: F.try_element_at("_labels", slot) for column, slot in slots.items()}

        def right(column: str) -> Column:
            return here[column] & self._text(F.col(column), column).eqNullSafe(self._text(label[column], column))

        if step.check is not None:
            self._count(f"{number} candidates", step.check)
        if step.kind == "delete":
            inserted = F.coalesce(F.map_contains_key("_labels", F.lit(step.rule_id + _SLOT)), F.lit(False))
            self._count(f"{number} before", inserted)
            self._keep({"_alive": F.col("_alive") & ~inserted})
            self._count(f"{number} after", inserted)
            return
        for place, column in enumerate(step.columns):
            self._count(f"{number} before {place}", right(column))
        new = {}
        for place, column in enumerate(step.columns):
            fixed = label[column]
            if step.kind == "swap":
                fixed = F.col(step.columns[1 - place])
            elif step.kind == "derive":
                fixed = step.fix(F.col(column), label[column])
                wrong = here[column] & ~self._text(fixed, column).eqNullSafe(self._text(label[column], column))
                example = F.to_json(F.struct(
                    F.col("_token").alias("primary_key"), F.lit(column).alias("column"), F.col(column).cast("string").alias("raw_value"),
                    self._text(fixed, column).alias("derived_value"), self._text(label[column], column).alias("label")))
                name = f"_e{number}_{place}"
                self._keep({name: F.when(F.col("_alive") & wrong, example)})
                self.metrics[f"{number} disagreement {place}"] = F.min(name)
            new[column] = F.when(
                functools.reduce(lambda one, other: one | other, here.values()) if step.kind == "swap" else here[column],
                fixed.cast(self.types[column])).otherwise(F.col(column))
        self._keep(new)
        for place, column in enumerate(step.columns):
            self._count(f"{number} after {place}", right(column))

    def run(self, columns: Sequence[str]) -> tuple[DataFrame, dict]:
        """Writes the table once; the counts come from the tasks that write it."""
        names = list(self.metrics)
        seen = Observation()
        observed = self.df.observe(seen, *[self.metrics[name].alias(f"m{no}") for no, name in enumerate(names)])
        after = cut_lineage(observed.filter("_alive").select(*columns))
        return after, {name: seen.get[f"m{no}"] for no, name in enumerate(names)}


def run_steps(dataset: Dataset, journal: DataFrame, steps: Sequence[Step], strict: bool = True) -> Repaired:
    """Run the steps in their order, with one report row per step.

    The steps of a table are one projection after one join with their labels, and it is written once: candidates,
    disagreements and open labels before and after each step are counted by the tasks that write it. Tables
    go side by side. With ``strict`` a step whose computed values differ from the labels, or
    that leaves labels unresolved, raises ``RepairError``. Steps of a table must not touch the same cell twice,
    which holds for journals of this library.
    """
    spark = journal.sparkSession
    counts = journal.groupBy("rule_id", "table").agg(
        F.count("*").alias("n"), F.count("corrupted_primary_key").alias("moved")).collect()  # a row a rule
    owners = {row["rule_id"]: row for row in counts}
    by_table: dict[str, list[tuple[int, Step]]] = {}
    for number, step in enumerate(steps, 1):
        if step.kind not in {"derive", "restore", "swap", "delete"}:
            raise ValueError(f"unknown kind of step: {step.kind}")
        if step.rule_id in owners:
            by_table.setdefault(owners[step.rule_id]["table"], []).append((number, step))

    def run(table: str) -> tuple[DataFrame, dict]:
        spec, mine = dataset.specs[table], by_table[table]
        rules = [step.rule_id for _, step in mine]
        here = journal.filter((F.col("table") == table) & F.col("rule_id").isin(*rules))
        if moved := sum(owners[rule]["moved"] for rule in rules):
            here = _relocated(here, moved)
        df = _slotted(dataset[table], spec, here, sum(owners[rule]["n"] for rule in rules))
        made = _Pass(df, spec)
        for number, step in mine:
            made.add(number, step)
        return made.run(dataset[table].columns)

    with ThreadPoolExecutor(max_workers=max(len(by_table), 1)) as pool:
        done = dict(zip(by_table, pool.map(run, by_table)))
    seen = {name: value for _, values in done.values() for name, value in values.items()}
    rows = []
    for number, step in enumerate(steps, 1):
        if step.rule_id not in owners:  # the rule made no fault
            rows.append((number, step.rule_id, step.kind, None, 0, 0))
            continue
        labels = owners[step.rule_id]["n"]
        if step.kind == "delete":
            before, after = seen[f"{number} before"], seen[f"{number} after"]
        else:
            before, after = (labels - sum(seen[f"{number} {when} {place}"] for place in range(len(step.columns))) for when in ("before", "after"))
        bad = [value for place in range(len(step.columns)) if (value := seen.get(f"{number} disagreement {place}"))]
        if strict and bad:
            raise RepairError(f"{step.rule_id}: {bad[0]}")
        if strict and after:
            raise RepairError(f"{step.rule_id}: {after} labels unresolved")
        rows.append((number, step.rule_id, step.kind, seen.get(f"{number} candidates"), before, after))
    report = spark.createDataFrame(
        rows, "step int, rule_id string, kind string, candidates bigint, before bigint, after bigint"
    )
    return Repaired(dataset.with_tables({table: df for table, (df, _) in done.items()}), report)


def repair_all(dataset: Dataset, journal: DataFrame, steps: Sequence[Step]) -> Dataset:
    """All steps at once: one join and one projection per table.

    For large tables. Steps of a table must not touch the same cell twice,
    which holds for journals of this library. Check the result with ``score``.
    """
    out: dict[str, DataFrame] = {}
    for table, shape in _shape(journal).items():
        spec = dataset.specs[table]
        mine = [step for step in steps if step.rule_id in shape.rules]
        here = journal.filter((F.col("table") == table) & F.col("rule_id").isin(*[step.rule_id for step in mine]))
        df = dataset[table]
        if any(step.kind == "delete" for step in mine):
            df = delete_inserted(df, spec, here, shape.inserts)
        types = _types(df)
        df = with_labels(df, spec, _relocated(here, shape.moved) if shape.moved else here, shape.updates)
        new: dict[str, Column] = {}
        for step in mine:
            if step.kind == "delete":
                continue
            for column in step.columns:
                if step.kind == "swap":
                    other = step.columns[1] if column == step.columns[0] else step.columns[0]
                    fixed = F.col(other).cast(types[column])
                elif step.kind == "derive":
                    fixed = step.fix(F.col(column), _label(column)).cast(types[column])
                else:
                    fixed = _label(column).cast(types[column])
                new[column] = F.when(_labelled(column), fixed).otherwise(F.col(column))
        out[table] = df.withColumns(new).drop("_labels")
    return dataset.with_tables(out)
