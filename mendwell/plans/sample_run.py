"""A seven-rule scenario over four tables, for the queries on journals and scores."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwell.functions import checks, fixes
from mendwell.operators.controls import draw_controls
from mendwell.operators.inject import Injected, inject
from mendwell.operators.repair import Step
from mendwell.plans import trade
from mendwell.plans.cases import BY_NAME, SEED
from mendwell.plans.scenarios import KEY_STEP
from mendwell.plans.sqlkit import ctes, token
from mendwell.spec import ControlScope, Dataset, Rule, Scenario

TABLES = ("customer", "lineitem", "orders", "part")


def _labelled(name: str, error: str, severity: str, action: str, recover: str) -> Rule:
    return replace(
        BY_NAME[name].rule, error_type=error, severity=severity, expected_action=action, recoverability=recover,
        description=f"{name} faults",
    )


SAMPLE = Scenario(
    id="sample", name="One fault of each family", seed=SEED, target_quality_score=50.0,
    control_scope=(
        ControlScope("customer", ("c_name", "c_phone")),
        ControlScope("lineitem", ("l_quantity",)),
        ControlScope("orders", ("o_orderpriority", "o_totalprice")),
        ControlScope("part", ("p_name", "p_type")),
    ),
    rules=(
        _labelled("placeholder", "placeholder_missing", "medium", "standardize_placeholder_to_null", "oracle_required"),
        _labelled("whitespace", "whitespace_noise", "low", "trim_and_collapse_whitespace", "rule_repairable"),
        _labelled("swapped_columns", "column_misalignment", "high", "detect_and_reverse_column_swap", "rule_repairable"),
        _labelled("negative_value", "invalid_numeric_domain", "high", "flag_and_repair_negative_value", "rule_repairable"),
        _labelled("missing_value", "missing_value", "medium", "fill_or_reference_missing", "oracle_required"),
        _labelled("corrupted_key", "foreign_key_violation", "high", "repair_from_product_reference", "reference_repairable"),
        Rule(
            "clone", "customer", ("c_custkey",), "duplicate_rows", one_in=50, params={"new_pk_base": KEY_STEP},
            error_type="semantic_duplicate", severity="medium", expected_action="deduplicate_by_business_fields",
            recoverability="rule_repairable", description="cloned customers",
        ),
    ),
)


def steps() -> list[Step]:
    c = F.col
    return [
        Step("clone", "delete", None, c("c_custkey") > KEY_STEP),
        Step("swap", "swap", None, None, ("p_brand", "p_type")),
        Step("key", "restore", None, c("l_partkey") >= KEY_STEP, ("l_partkey",)),
        Step("missing", "restore", None, checks.missing(c("o_orderpriority")), ("o_orderpriority",)),
        Step("placeholder", "restore", None, checks.missing_word(c("c_phone")), ("c_phone",)),
        Step("negative", "derive", lambda v, _: fixes.absolute(v), checks.below_domain(c("o_totalprice")), ("o_totalprice",)),
        Step("whitespace", "derive", lambda v, _: fixes.collapse_whitespace(v), checks.whitespace_noise(c("p_name")), ("p_name",)),
    ]


@dataclass
class SampleRun:
    clean: Dataset
    injected: Injected

    @property
    def dirty(self) -> Dataset:
        return self.injected.dataset

    @property
    def journal(self) -> DataFrame:
        return self.injected.journal

    def controls(self) -> DataFrame:
        return draw_controls(self.clean, SAMPLE, self.journal, self.injected.faults)


def sample_run(spark: SparkSession, folder: str, scenario: Scenario = SAMPLE) -> SampleRun:
    clean = trade.dataset(spark, folder, TABLES)
    return SampleRun(clean, inject(clean, scenario))


_CASES = ("placeholder", "whitespace", "swapped_columns", "negative_value", "missing_value", "corrupted_key")


def _updates_sql(no: int, name: str) -> str:
    case = BY_NAME[name]
    rule = SAMPLE.rules[no]
    moved = "NULL::VARCHAR"
    if name == "corrupted_key":
        moved = token("lineitem").replace("|| l_partkey ||", "|| new_l_partkey ||")
    return " UNION ALL ".join(
        f"""SELECT {no}::BIGINT AS rule_no, '{rule.rule_id}' AS rule_id, 'update_cell' AS operation, '{rule.table}' AS "table",
            tok AS primary_key, {place} AS column_no, '{column}' AS "column", {column}::VARCHAR AS clean_value,
            new_{column}::VARCHAR AS corrupted_value, {moved} AS corrupted_primary_key, '{rule.error_type}' AS error_type
            FROM ({ctes(case.sql_ctes())} SELECT * FROM changes WHERE new_{column} IS DISTINCT FROM {column})"""
        for place, column in enumerate(rule.columns)
    )


def _dirty_sql(name: str) -> str:
    return f"SELECT * EXCLUDE (tok) FROM ({ctes(BY_NAME[name].sql_ctes())} SELECT * FROM dirty)"


CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_contact", "c_title", "c_phone")


def _clones_sql() -> str:
    return f"""SELECT * EXCLUDE (tok, rk, elig), {KEY_STEP} + row_number() OVER (ORDER BY tok) AS new_key FROM (
        SELECT *, row_number() OVER (ORDER BY md5('{SEED}|clone|' || tok)) AS rk, count(*) OVER () AS elig
        FROM (SELECT *, {token('customer')} AS tok FROM dirty_customer)) WHERE rk <= elig // 50"""


def _text(column: str, value: str | None = None) -> str:
    return f"{column} := ({value or column})::VARCHAR"


def sample_ctes() -> dict[str, str]:
    """``journal`` and the clean (``t_…``) and dirty (``dirty_…``) tables."""
    clone_json = ", ".join(_text(name, "new_key" if name == "c_custkey" else None) for name in CUSTOMER_COLUMNS)
    inserts = f"""SELECT 6::BIGINT AS rule_no, 'clone' AS rule_id, 'insert_row' AS operation, 'customer' AS "table",
        '{{"c_custkey":' || new_key || '}}' AS primary_key, 0 AS column_no, NULL::VARCHAR AS "column",
        NULL::VARCHAR AS clean_value, to_json(struct_pack({clone_json}))::VARCHAR AS corrupted_value,
        NULL::VARCHAR AS corrupted_primary_key, 'semantic_duplicate' AS error_type FROM clones"""
    updates = " UNION ALL ".join(_updates_sql(no, name) for no, name in enumerate(_CASES))
    # Rules on the same table touch different columns, so the dirty table joins them.
    return {
        "t_customer": trade.SQL_TABLES["t_customer"],
        "t_part": trade.SQL_TABLES["t_part"],
        "t_orders": trade.SQL_TABLES["t_orders"],
        "t_lineitem": trade.SQL_TABLES["t_lineitem"],
        "dirty_customer": _dirty_sql("placeholder"),
        "clones": _clones_sql(),
        "all_customer": """SELECT * FROM dirty_customer UNION ALL BY NAME
                           SELECT * EXCLUDE (new_key) REPLACE (new_key AS c_custkey) FROM clones""",
        "dirty_part": f"""SELECT a.* REPLACE (b.p_brand AS p_brand, b.p_type AS p_type)
                          FROM ({_dirty_sql('whitespace')}) a JOIN ({_dirty_sql('swapped_columns')}) b USING (p_partkey)""",
        "dirty_orders": f"""SELECT a.* REPLACE (b.o_orderpriority AS o_orderpriority)
                            FROM ({_dirty_sql('negative_value')}) a JOIN ({_dirty_sql('missing_value')}) b USING (o_orderkey)""",
        "dirty_lineitem": _dirty_sql("corrupted_key"),
        "records": f"{updates} UNION ALL {inserts}",
        "journal": """SELECT 'sample-OP-' || lpad(op_seq::VARCHAR, 6, '0') AS operation_id, * FROM (
                      SELECT row_number() OVER (ORDER BY rule_no, primary_key, column_no) AS op_seq, * FROM records)""",
    }


def sample_sql(query: str, **more: str) -> str:
    return ctes({**sample_ctes(), **more}) + "\n" + query


CONTROL_CELLS = " UNION ALL ".join(
    f"""SELECT '{scope.table}' AS "table", {token(scope.table)} AS primary_key, '{column}' AS "column",
        {column}::VARCHAR AS clean_value FROM t_{scope.table}"""
    for scope in SAMPLE.control_scope
    for column in scope.columns
)

CONTROL_CTES = {
    "cells": CONTROL_CELLS,
    "candidates": """SELECT c.* FROM cells c
        WHERE NOT EXISTS (SELECT 1 FROM journal j WHERE j."table" = c."table" AND j.primary_key = c.primary_key
                          AND (j."column" = c."column" OR j.corrupted_primary_key IS NOT NULL))""",
    "controls": f"""SELECT 'sample-CTRL-' || lpad(row_number() OVER (ORDER BY "table", primary_key, "column")::VARCHAR, 6, '0') AS control_id,
        "table", primary_key, "column", clean_value FROM (
        SELECT *, row_number() OVER (ORDER BY md5('{SEED + 9173}|controls|' || "table" || '|' || primary_key || '|' || "column")) AS rk
        FROM candidates) WHERE rk <= (SELECT count(*) FROM journal)""",
}


# --- Repair and score of the sample run, for the SQL side ---------------------

DIRTY_TABLES = {"customer": "all_customer", "lineitem": "dirty_lineitem", "orders": "dirty_orders", "part": "dirty_part"}
FIXED_TABLES = {name: f"fixed_{name}" for name in DIRTY_TABLES}


def _label(rule_id: str, table: str, moved: bool = False) -> str:
    key = "corrupted_primary_key" if moved else "primary_key"
    return f"""LEFT JOIN (SELECT {key} AS key, clean_value FROM journal WHERE rule_id = '{rule_id}') AS l_{rule_id}
        ON l_{rule_id}.key = {token(table)}"""


REPAIR_CTES = {
    "fixed_customer": f"""SELECT d.* REPLACE (CASE WHEN l_placeholder.key IS NULL THEN c_phone ELSE l_placeholder.clean_value END AS c_phone)
        FROM all_customer d {_label('placeholder', 'customer')}
        WHERE {token('customer')} NOT IN (SELECT primary_key FROM journal WHERE operation = 'insert_row')""",
    "fixed_part": f"""SELECT d.* REPLACE (
            CASE WHEN l_whitespace.key IS NULL THEN p_name ELSE trim(regexp_replace(p_name, '\\s+', ' ', 'g')) END AS p_name,
            CASE WHEN s.key IS NULL THEN p_brand ELSE p_type END AS p_brand, CASE WHEN s.key IS NULL THEN p_type ELSE p_brand END AS p_type)
        FROM dirty_part d {_label('whitespace', 'part')}
        LEFT JOIN (SELECT DISTINCT primary_key AS key FROM journal WHERE rule_id = 'swap') s ON s.key = {token('part')}""",
    "fixed_orders": f"""SELECT d.* REPLACE (
            CASE WHEN l_negative.key IS NULL THEN o_totalprice ELSE abs(o_totalprice) END AS o_totalprice,
            CASE WHEN l_missing.key IS NULL THEN o_orderpriority ELSE l_missing.clean_value END AS o_orderpriority)
        FROM dirty_orders d {_label('negative', 'orders')} {_label('missing', 'orders')}""",
    "fixed_lineitem": f"""SELECT d.* REPLACE (CASE WHEN l_key.key IS NULL THEN l_partkey ELSE l_key.clean_value::BIGINT END AS l_partkey)
        FROM dirty_lineitem d {_label('key', 'lineitem', moved=True)}""",
}


def score_ctes(stage: str, tables: dict[str, str]) -> dict[str, str]:
    """``<stage>_quality``: one row of scores, from the cells that the tables hold."""
    wanted = {(rule.table, column) for rule in SAMPLE.rules for column in rule.columns}
    wanted |= {(scope.table, column) for scope in SAMPLE.control_scope for column in scope.columns}
    cells = " UNION ALL ".join(
        f"""SELECT '{table}' AS tab, {token(table)} AS key, '{column}' AS col, {column}::VARCHAR AS v FROM {tables[table]}"""
        for table, column in sorted(wanted)
    )
    return {
        f"{stage}_cells": cells,
        f"{stage}_faults": f"""SELECT CASE WHEN operation = 'insert_row' THEN j.primary_key NOT IN (SELECT key FROM {stage}_cells WHERE tab = 'customer')
            ELSE coalesce((c.key IS NOT NULL AND c.v IS NOT DISTINCT FROM j.clean_value)
                          OR (m.key IS NOT NULL AND m.v IS NOT DISTINCT FROM j.clean_value), FALSE) END AS good
            FROM journal j LEFT JOIN {stage}_cells c ON c.tab = j."table" AND c.col = j."column" AND c.key = j.primary_key
            LEFT JOIN {stage}_cells m ON m.tab = j."table" AND m.col = j."column" AND m.key = j.corrupted_primary_key""",
        f"{stage}_kept": f"""SELECT c.key IS NOT NULL AND c.v IS NOT DISTINCT FROM k.clean_value AS good FROM controls k
            LEFT JOIN {stage}_cells c ON c.tab = k."table" AND c.col = k."column" AND c.key = k.primary_key""",
        f"{stage}_quality": f"""SELECT round(100.0 * (f.good + k.good) / (f.n + k.n), 4)::DOUBLE AS quality_score,
            (f.n - f.good)::BIGINT AS remaining_faults, (k.n - k.good)::BIGINT AS false_positives
            FROM (SELECT count(*) FILTER (good) AS good, count(*) AS n FROM {stage}_faults) f,
                 (SELECT count(*) FILTER (good) AS good, count(*) AS n FROM {stage}_kept) k""",
        f"{stage}_tables": " UNION ALL ".join(
            f"""SELECT '{name}' AS tab, NOT EXISTS (SELECT * FROM {source} EXCEPT ALL SELECT * FROM t_{name})
                AND (SELECT count(*) FROM {source}) = (SELECT count(*) FROM t_{name}) AS same""" for name, source in tables.items()),
        f"{stage}_violations": f"""SELECT ((SELECT count(*) FROM {tables['lineitem']} WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
            + (SELECT count(*) FROM {tables['orders']} WHERE o_totalprice < 0))::BIGINT AS n""",
    }


STAGE_CTES = {**CONTROL_CTES, **REPAIR_CTES, **score_ctes("raw", DIRTY_TABLES), **score_ctes("clean", FIXED_TABLES)}
