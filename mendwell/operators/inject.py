"""Put journalled faults into a clean dataset.

A rule is one projection: the drawn rows are recognised by their hash inside
the expression, so a large table is neither sorted nor shuffled. Only rules
whose effect depends on a row's place among the drawn rows join the drawn rows
(their keys, that is) back to the table.

The state of a run travels with the rows in hidden columns: which cells an
earlier rule has used.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwell.functions.faults import CYCLIC, TEXT_MAKING, faulty
from mendwell.functions.text import canonical_value, key_token, row_json
from mendwell.operators.sampling import Cut, Draw, draw_hash, draw_rows, kept_where, with_index
from mendwell.session import cut_lineage, meet, small_side
from mendwell.spec import Dataset, Rule, Scenario, TableSpec

_USED = "_used_"
_RECORD = (
    "rule_no bigint, rule_id string, operation string, table string, primary_key string, column_no int, "
    "column string, clean_value string, corrupted_value string, value_type string, "
    "corrupted_primary_key string, error_type string, severity string, expected_action string, "
    "recoverability string"
)
_RECORD_COLUMNS = [part.split()[0] for part in _RECORD.split(", ")]


@dataclass
class Injected:
    """A dirty dataset, the journal of its faults and one row per rule."""

    dataset: Dataset
    journal: DataFrame
    rule_statistics: DataFrame
    faults: int


def _as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    types = _types(df)
    return df.withColumns({
        name: canonical_value(F.col(name), types[name])
        for name in columns
        if not isinstance(types[name], T.StringType)
    })


def raw_text_layer(dataset: Dataset, rules: Sequence[Rule]) -> Dataset:
    """The dataset with those columns as text that the rules fill with text."""
    wanted: dict[str, set[str]] = {}
    for rule in rules:
        if rule.transform in TEXT_MAKING:
            wanted.setdefault(rule.table, set()).update(rule.columns)
    return dataset.with_tables({table: _as_text(dataset[table], sorted(names)) for table, names in wanted.items()})


def visible(df: DataFrame) -> DataFrame:
    """Without the hidden columns of a run."""
    return df.drop(*[name for name in df.columns if name.startswith(_USED)])


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {field.name: field.dataType for field in df.schema.fields}


def _open(df: DataFrame, rule: Rule, spec: TableSpec, columns: Sequence[str]) -> Column:
    """Eligible for the rule: its predicate holds and no target cell is used,
    nor the key, by which the row could no longer be found."""
    condition = F.expr(rule.where) if rule.where.strip() else F.lit(True)
    for column in dict.fromkeys([*columns, *spec.primary_key]):
        if _USED + column in df.columns:
            condition = condition & ~F.col(_USED + column)
    return F.coalesce(condition, F.lit(False))


def _wish(df: DataFrame, rule: Rule, spec: TableSpec, seed: int) -> Draw:
    columns = () if rule.transform == "duplicate_rows" else rule.columns
    hashed = draw_hash(seed, rule.rule_id, key_token(spec.primary_key))
    return Draw(rule.rule_id, _open(df, rule, spec, columns), hashed, rule.count, rule.one_in)


def _drawn(df: DataFrame, rule: Rule, spec: TableSpec, seed: int, cut: Cut) -> Column:
    wish = _wish(df, rule, spec, seed)
    return wish.eligible & cut.contains(wish.hashed)


def _indexed(drawn: DataFrame, cut: Cut) -> DataFrame:
    return with_index(drawn, ["_token"], "_index", cut.taken)


def _labels(rule: Rule) -> list[Column]:
    return [
        F.lit(rule.error_type).alias("error_type"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.expected_action).alias("expected_action"),
        F.lit(rule.recoverability).alias("recoverability"),
    ]


def _cell_records(
    rule: Rule, rule_no: int, spec: TableSpec, types: Mapping[str, T.DataType],
    old: Mapping[str, Column], new: Mapping[str, Column], drawn: Column,
) -> list[Column]:
    """A journal record per column of the rule; NULL where the cell stays."""
    nothing = F.lit(None).cast("string")
    moved = key_token(spec.primary_key, [new.get(key, F.col(key)) for key in spec.primary_key])
    return [
        F.when(
            drawn & ~old[column].eqNullSafe(new[column]),
            F.struct(
                F.lit(rule_no).cast("bigint").alias("rule_no"),
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit("update_cell").alias("operation"),
                F.lit(rule.table).alias("table"),
                F.lit(no).alias("column_no"),
                F.lit(column).alias("column"),
                canonical_value(old[column], types[column]).alias("clean_value"),
                canonical_value(new[column], types[column]).alias("corrupted_value"),
                F.lit(types[column].simpleString()).alias("value_type"),
                (moved if column in spec.primary_key else nothing).alias("corrupted_primary_key"),
                *_labels(rule),
            ),
        )
        for no, column in enumerate(rule.columns)
    ]


def _journal_rows(df: DataFrame, token: Column, records: Sequence[Column]) -> DataFrame:
    rows = df.select(token.alias("primary_key"), F.inline(F.array_compact(F.array(*records))))
    return rows.select(*_RECORD_COLUMNS)


def _new_values(rule: Rule, types: Mapping[str, T.DataType], index: Column) -> dict[str, Column]:
    if rule.transform == "swap_columns":
        left, right = rule.columns
        return {left: F.col(right).cast(types[left]), right: F.col(left).cast(types[right])}
    return {column: faulty(rule.transform, F.col(column), types[column], index, rule.params) for column in rule.columns}


def apply_plain(
    df: DataFrame, rules: Sequence[tuple[int, Rule]], spec: TableSpec, seed: int, cuts: Mapping[int, Cut], apart: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules that look at nothing but their own row and do not touch each other's columns: together one projection.

    ``apart`` has the drawn rows alone, marked by rule: the journal comes from them. Returns the table, the drawn rows after the rules, and the journal rows.
    """
    marks = {f"_drawn_{no}": _drawn(df, rule, spec, seed, cuts[no]) for no, rule in rules}
    after, _ = _plainly(df.withColumns(marks), rules, spec, df.columns)
    drawn, records = _plainly(apart.withColumns({f"_drawn_{no}": F.col(f"_mark_{no}") for no, _ in rules}), rules, spec, apart.columns)
    any_drawn = reduce(lambda one, other: one | other, [F.col(f"_mark_{no}") for no, _ in rules])
    return after, drawn, _journal_rows(records[0].filter(any_drawn), key_token(spec.primary_key), records[1])


def _plainly(
    marked: DataFrame, rules: Sequence[tuple[int, Rule]], spec: TableSpec, columns: Sequence[str]
) -> tuple[DataFrame, tuple[DataFrame, list[Column]]]:
    """Rows marked by rule after plain rules; and the rows with old and new values, of which the records are made."""
    before = marked
    for _, rule in rules:
        if rule.transform in TEXT_MAKING:
            marked = _as_text(marked, rule.columns)
    types = _types(marked)
    new = {no: _new_values(rule, types, F.lit(0)) for no, rule in rules}
    marked = marked.withColumns({f"_new_{no}_{c}": value for no, values in new.items() for c, value in values.items()})
    records, updates = [], {}
    for no, rule in rules:
        drawn = F.col(f"_drawn_{no}")
        old = {column: F.col(column) for column in rule.columns}
        fresh = {column: F.col(f"_new_{no}_{column}") for column in rule.columns}
        records += _cell_records(rule, no, spec, types, old, fresh, drawn)
        updates.update(_updates(before, rule, drawn, fresh))
    return marked.withColumns(updates).select(*dict.fromkeys([*columns, *updates])), (marked, records)


def _updates(df: DataFrame, rule: Rule, drawn: Column, new: Mapping[str, Column]) -> dict[str, Column]:
    """Cells of the rule with their faults, and what is used by now."""
    updates = {}
    for column in rule.columns:
        earlier = F.col(_USED + column) if _USED + column in df.columns else F.lit(False)
        changed = drawn & ~F.col(column).eqNullSafe(new[column])
        updates[column] = F.when(drawn, new[column]).otherwise(F.col(column))
        updates[_USED + column] = earlier | changed
    return updates


def _cycled(drawn: DataFrame, rule: Rule, rule_no: int, spec: TableSpec, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """New values of a transform that takes turns among variants along the drawn rows, by key, and their journal rows."""
    drawn = drawn.select("_token", *dict.fromkeys([*spec.primary_key, *rule.columns]))
    sample = cut_lineage(_indexed(_as_text(drawn, rule.columns), cut))
    types = _types(sample)
    new = _new_values(rule, types, F.col("_index"))
    old = {column: F.col(column) for column in rule.columns}
    journal = _journal_rows(sample, F.col("_token"), _cell_records(rule, rule_no, spec, types, old, new, F.lit(True)))
    return sample.select("_token", *[new[column].alias(column) for column in rule.columns]), journal


def _rotated(drawn: DataFrame, rule: Rule, rule_no: int, spec: TableSpec, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """New values where each drawn row takes those of the drawn row ``shift`` places on, and their journal rows.

    Where a value would not change, the row turns to the next donor and stays
    with it for its remaining columns.
    """
    types = _types(drawn)
    shift = int(rule.params.get("shift", 1)) % cut.taken or 1
    drawn = drawn.select("_token", *spec.primary_key, *[F.col(column).alias(f"_old_{column}") for column in rule.columns])
    sample = cut_lineage(_indexed(drawn, cut))

    def donors(step: int, name: str) -> DataFrame:
        place = F.pmod(F.col("_index") - F.lit(shift + step), F.lit(cut.taken))
        return sample.select(
            place.alias("_index"), *[F.col(f"_old_{column}").alias(f"{name}{column}") for column in rule.columns]
        )

    paired = sample.join(small_side(donors(0, "_one_"), cut.taken), "_index").join(small_side(donors(1, "_two_"), cut.taken), "_index")
    turned: Column = F.lit(False)
    values: dict[str, Column] = {}
    for column in rule.columns:
        turned = turned | F.col(f"_one_{column}").eqNullSafe(F.col(f"_old_{column}"))
        values[f"_new_{column}"] = F.when(turned, F.col(f"_two_{column}")).otherwise(F.col(f"_one_{column}"))
    changes = cut_lineage(paired.withColumns(values))
    old = {column: F.col(f"_old_{column}") for column in rule.columns}
    new = {column: F.col(f"_new_{column}") for column in rule.columns}
    journal = _journal_rows(changes, F.col("_token"), _cell_records(rule, rule_no, spec, types, old, new, F.lit(True)))
    return changes.select("_token", *[new[column].alias(column) for column in rule.columns]), journal


def drawn_apart(
    df: DataFrame, rules: Sequence[tuple[int, Rule]], spec: TableSpec, seed: int, cuts: Mapping[int, Cut], apart: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rules that need the place of a row among the drawn ones, all of an independent run at once.

    Whether a row is drawn shows in its own hash, so the table falls into two parts by a
    filter: rows of none of the rules pass by as they are, and the drawn ones alone meet their new values,
    those of all rules in one join. The drawn ones, marked by rule, are written once for all that reads them, unless the caller
    has them (``apart``). Returns both parts, the drawn rows with all marks of ``apart``, and the journal rows.
    """
    values, journal, flags = [], [], {}
    marks = {f"_mark_{no}": _drawn(df, rule, spec, seed, cuts[no]) for no, rule in rules}
    any_mark = reduce(lambda one, other: one | other, [F.col(name) for name in marks])
    if apart is None:
        apart = cut_lineage(kept_where(df.withColumns(marks), any_mark))
        others = []
    else:
        apart, others = apart.filter(any_mark), [name for name in apart.columns if name.startswith("_mark_")]
    apart = apart.withColumn("_token", key_token(spec.primary_key))
    for no, rule in rules:
        made, records = (_rotated if rule.transform == "rotate_values" else _cycled)(
            apart.filter(f"_mark_{no}"), rule, no, spec, cuts[no])
        flags[no] = f"_drawn_{no}"
        values.append(made.select("_token", F.lit(True).alias(flags[no]), *[
            F.col(column).alias(f"_new_{no}_{column}") for column in rule.columns]))
        journal.append(records)
    back = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), values)
    if len(values) > 1:  # a row that several rules have drawn
        back = back.groupBy("_token").agg(*[F.max(name).alias(name) for name in back.columns if name != "_token"])
    rest = kept_where(df.withColumns(marks), ~any_mark)
    for _, rule in rules:
        if rule.transform in TEXT_MAKING:
            rest, apart = _as_text(rest, rule.columns), _as_text(apart, rule.columns)
    met = apart.join(small_side(back, sum(cuts[no].taken for no, _ in rules)), "_token", "left")
    changed, same = {}, {}
    for no, rule in rules:
        fresh = {column: F.col(f"_new_{no}_{column}") for column in rule.columns}
        changed.update(_updates(df, rule, F.coalesce(F.col(flags[no]), F.lit(False)), fresh))
        same.update({
            _USED + column: F.col(_USED + column) if _USED + column in df.columns else F.lit(False) for column in rule.columns
        })
    columns = list(dict.fromkeys([*df.columns, *changed]))
    return rest.withColumns(same).select(*columns), met.withColumns(changed).select(*columns, *others), journal


def apply_duplication(
    df: DataFrame, rule: Rule, rule_no: int, spec: TableSpec, cut: Cut, source: DataFrame, drawn: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Clone ``drawn`` rows, as they are now, under new keys. ``source`` has the keys of ``df``, and is easier to get."""
    key = spec.primary_key[0]
    drawn = drawn.withColumn("_token", key_token([key]))
    sample = _indexed(drawn, cut)
    number = F.col("_index") + 1
    dtype = _types(df)[key]
    if isinstance(dtype, T.StringType):
        new_key = F.concat(F.lit(rule.params.get("new_pk_prefix", "Z")), F.format_string("%04d", number))
    else:
        base = rule.params.get("new_pk_base")
        if base is None:
            base = source.agg(F.max(key)).first()[0] or 0
        new_key = (number + int(base)).cast(dtype)
    clones = cut_lineage(sample.withColumn(key, new_key).drop("_index", "_token"))
    taken = source.select(key).join(small_side(clones.select(key), cut.taken), key, "left_semi").first()
    if taken is not None:
        raise ValueError(f"{rule.rule_id}: the new key {taken[0]!r} is taken")
    plain = visible(clones)
    nothing = F.lit(None).cast("string")
    records = plain.select(
        F.lit(rule_no).cast("bigint").alias("rule_no"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit("insert_row").alias("operation"),
        F.lit(rule.table).alias("table"),
        key_token([key]).alias("primary_key"),
        F.lit(0).alias("column_no"),
        nothing.alias("column"),
        nothing.alias("clean_value"),
        row_json(plain).alias("corrupted_value"),
        nothing.alias("value_type"),
        nothing.alias("corrupted_primary_key"),
        *_labels(rule),
    )
    return df.unionByName(clones), records


def _with_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns; flags of used cells that are not there are false."""
    return df.withColumns({name: F.lit(False) for name in columns if name not in df.columns}).select(*columns)


def _is_plain(rule: Rule) -> bool:
    return rule.transform not in CYCLIC and rule.transform not in {"rotate_values", "duplicate_rows"}


def _reads(rule: Rule, column: str) -> bool:
    named = {*rule.columns, *rule.extra_columns, rule.params.get("source_column")}
    return column in named or re.search(rf"\b{re.escape(column)}\b", rule.where, re.IGNORECASE) is not None


def _writes(rule: Rule) -> set[str]:
    return set() if rule.transform == "duplicate_rows" else set(rule.columns)


def independent_runs(rules: Sequence[tuple[int, Rule]], spec: TableSpec) -> list[list[tuple[int, Rule]]]:
    """Stretches of rules of which none reads what another one writes.

    A corrupted key concerns every later rule, and so do cloned rows.
    """
    runs: list[list[tuple[int, Rule]]] = []

    def clash(earlier: Rule, later: Rule) -> bool:
        return (
            earlier.transform == "duplicate_rows"
            or bool(_writes(earlier) & set(spec.primary_key))
            or any(_reads(later, column) for column in _writes(earlier))
            or any(_reads(earlier, column) for column in _writes(later))
        )

    for no, rule in rules:
        if not runs or any(clash(earlier, rule) for _, earlier in runs[-1]):
            runs.append([])
        runs[-1].append((no, rule))
    return runs


def apply_rules(
    df: DataFrame, rules: Sequence[tuple[int, Rule]], spec: TableSpec, seed: int
) -> tuple[DataFrame, list[DataFrame], dict[int, Cut]]:
    """The table after numbered rules, their journal rows, and what they drew.

    Rules that do not depend on each other draw together, in two passes over
    the table, of which the second writes the drawn rows apart. Plain ones are written by one projection; all are journalled from the drawn
    rows. Those that number their rows work on these alone, all of a run in one
    join; between runs that join, the table is written.
    """
    for _, rule in rules:
        if rule.transform == "duplicate_rows" and len(spec.primary_key) != 1:
            raise ValueError(f"{rule.rule_id}: duplicate_rows needs a single-column primary key")
    journal: list[DataFrame] = []
    drawn: dict[int, Cut] = {}
    joined = False
    for run in independent_runs(rules, spec):
        if joined:
            df, joined = cut_lineage(df), False
        source = df
        wishes = [_wish(df, rule, spec, seed) for _, rule in run]
        found, apart = draw_rows(df, wishes, [f"_mark_{no}" for no, _ in run])
        cuts = dict(zip([no for no, _ in run], found, strict=True))
        drawn.update(cuts)
        plain = [(no, rule) for no, rule in run if _is_plain(rule)]
        if plain:
            df, apart, records = apply_plain(df, plain, spec, seed, cuts, apart)
            journal.append(records)
        numbered = [
            (no, rule) for no, rule in run
            if rule.transform in CYCLIC or (rule.transform == "rotate_values" and cuts[no].taken > 1)
        ]
        if numbered:
            same, changed, records = drawn_apart(df, numbered, spec, seed, cuts, apart)
            df, joined = same.unionByName(changed.select(*same.columns)), True
            passed = apart.filter(~reduce(lambda one, other: one | other, [F.col(f"_mark_{no}") for no, _ in numbered]))
            for _, rule in numbered:
                passed = _as_text(passed, rule.columns) if rule.transform in TEXT_MAKING else passed
            apart = _with_flags(passed, changed.columns).unionByName(changed)
            journal += records
        for no, rule in run:
            if rule.transform == "duplicate_rows":
                chosen = _with_flags(apart.filter(f"_mark_{no}"), df.columns)
                df, records = apply_duplication(df, rule, no, spec, cuts[no], source, chosen)
                journal.append(records)
                joined = True
    if not journal:
        journal.append(df.sparkSession.createDataFrame([], _RECORD))
    return df, journal, drawn


def apply_rule(df: DataFrame, rule: Rule, spec: TableSpec, seed: int) -> tuple[DataFrame, DataFrame]:
    """The table after one rule, and its journal rows."""
    after, journal, _ = apply_rules(df, [(0, rule)], spec, seed)
    return visible(after), journal[0]


def numbered_journal(records: DataFrame, scenario_id: str, bound: int) -> DataFrame:
    """Journal rows in order of application, with operation ids."""
    ordered = with_index(records, ["rule_no", "primary_key", "column_no"], "_place", bound)
    number = F.col("_place") + 1
    return ordered.select(
        F.concat(F.lit(f"{scenario_id}-OP-"), F.format_string("%06d", number)).alias("operation_id"),
        number.alias("op_seq"),
        *[name for name in records.columns if name != "column_no"],
    )


def rule_statistics(journal: DataFrame, rules: Sequence[Rule], requested: Mapping[str, int] | None = None) -> DataFrame:
    """Rows asked for and assertions generated, one row per rule."""
    spark = journal.sparkSession
    wanted = spark.createDataFrame(
        [
            (no, rule.rule_id, rule.description, (requested or {}).get(rule.rule_id, rule.count), rule.expected_action, rule.severity)
            for no, rule in enumerate(rules)
        ],
        "rule_no bigint, rule_id string, description string, requested_rows bigint, expected_action string, severity string",
    )
    made = journal.groupBy("rule_id").agg(F.count("*").alias("generated_assertions"))
    return wanted.join(made, "rule_id", "left").fillna(0, ["generated_assertions"])


def _refuse_met_keys(df: DataFrame, spec: TableSpec, journal: DataFrame) -> None:
    """A corrupted key must be the key of one row, or its labels could not find that row."""
    moved = journal.filter(F.col("table") == spec.name).filter(F.col("corrupted_primary_key").isNotNull())
    keys = moved.select(F.col("corrupted_primary_key").alias("token")).distinct()
    met = meet(df.select(key_token(spec.primary_key).alias("token")), keys, ["token"], "left_semi").groupBy("token").count()
    twice = met.filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"{spec.name}: {twice['count']} rows have the corrupted key {twice['token']}")


def inject(dataset: Dataset, scenario: Scenario) -> Injected:
    """Apply the rules of a scenario in order, each to the result of the last.

    A rule sees and changes one table only, so the tables go side by side: their
    jobs share the cluster. The lineage of a table ends in the shared folder.
    """
    by_table: dict[str, list[tuple[int, Rule]]] = {}
    for no, rule in enumerate(scenario.rules):
        by_table.setdefault(rule.table, []).append((no, rule))

    def run(table: str) -> tuple[DataFrame, DataFrame, dict[int, Cut]]:
        df, made, drawn = apply_rules(dataset[table], by_table[table], dataset.specs[table], scenario.seed)
        return cut_lineage(visible(df)), cut_lineage(reduce(DataFrame.unionByName, made)), drawn

    with ThreadPoolExecutor(max_workers=len(by_table)) as pool:
        done = dict(zip(by_table, pool.map(run, by_table)))
    drawn = {no: cut.taken for _, _, cuts in done.values() for no, cut in cuts.items()}
    requested = {rule.rule_id: drawn[no] for no, rule in enumerate(scenario.rules)}
    bound = sum(drawn[no] * len(rule.columns) for no, rule in enumerate(scenario.rules))
    records = reduce(DataFrame.unionByName, [made for _, made, _ in done.values()])
    journal = cut_lineage(numbered_journal(records, scenario.id, bound))
    twice = journal.groupBy("rule_id", "primary_key", "column").count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['rule_id']}: the key {twice['primary_key']} has several rows, so labels could not find one")
    after = dataset.with_tables({table: df for table, (df, _, _) in done.items()})
    keyed = {rule.table for rule in scenario.rules if _writes(rule) & set(dataset.specs[rule.table].primary_key)}
    for table in sorted(keyed):
        _refuse_met_keys(after[table], dataset.specs[table], journal)
    return Injected(
        after,
        journal,
        rule_statistics(journal, scenario.rules, requested),
        journal.count(),
    )


def plan_of(rules: Sequence[Rule], journal: DataFrame, examples: int = 3) -> DataFrame:
    """One row per rule with its assertions and its first examples."""
    spark = journal.sparkSession
    described = spark.createDataFrame(
        [
            (rule.rule_id, rule.table, list(rule.columns), rule.error_type, rule.expected_action, rule.recoverability)
            for rule in rules
        ],
        "rule_id string, table string, columns array<string>, error_type string, expected_action string, recoverability string",
    )
    example = F.struct(
        "op_seq", "primary_key", "column",
        F.col("corrupted_value").alias("raw_value"), "clean_value",
    )
    counts = journal.groupBy("rule_id").agg(
        F.count("*").alias("affected_assertions"),
        F.min("op_seq").alias("_first"),
    )
    # The records of a rule are numbered without gaps, so its first examples
    # are a range of numbers and nothing has to be ranked.
    first = (
        journal.join(F.broadcast(counts.select("rule_id", "_first")), "rule_id")
        .filter(F.col("op_seq") < F.col("_first") + examples)
        .groupBy("rule_id")
        .agg(F.array_sort(F.collect_list(example)).alias("examples"))
    )
    return (
        described.join(counts.drop("_first"), "rule_id", "left")
        .join(first, "rule_id", "left")
        .fillna(0, ["affected_assertions"])
    )
