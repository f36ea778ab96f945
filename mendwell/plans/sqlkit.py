"""SQL text for the checks: the same draws and faults, written for a row engine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from mendwell.plans.trade import SPECS, SQL_TABLES
from mendwell.spec import Rule

VIEW_OF = {"orders": "t_orders", "lineitem": "t_lineitem", "customer": "t_customer", "part": "t_part", "priced": "t_priced"}
TEXT_KEYS = {"row_id"}


def token(table: str) -> str:
    """The canonical key text of a row."""
    parts = []
    for name in sorted(SPECS["lineitem" if table == "priced" else table].primary_key):
        parts.append(f"""'"{name}":"' || {name} || '"'""" if name in TEXT_KEYS else f"""'"{name}":' || {name}""")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def ctes(named: Mapping[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in named.items())


def trade_ctes(*tables: str) -> dict[str, str]:
    return {VIEW_OF[name]: SQL_TABLES[VIEW_OF[name]] for name in tables if name in VIEW_OF}


def drawn_ctes(rule: Rule, seed: int, table: str, new: Mapping[str, str], source: str | None = None, text: Sequence[str] = ()) -> dict[str, str]:
    """``base`` (all rows with their key text), ``changes`` (drawn rows with
    ``new_<column>``) and ``dirty`` (the table after the rule)."""
    share = f"elig // {rule.one_in}" if rule.one_in else str(rule.count)
    where = rule.where or "TRUE"
    columns = ", ".join(f"({expression}) AS new_{name}" for name, expression in new.items())
    replaced = ", ".join(
        f"CASE WHEN c.tok IS NULL THEN b.{name}{'::VARCHAR' if name in text else ''} ELSE c.new_{name} END AS {name}"
        for name in new
    )
    return {
        **trade_ctes(table),
        "base": f"SELECT *, {token(table)} AS tok FROM {source or VIEW_OF.get(table, table)}",
        "ranked": f"""SELECT *, row_number() OVER (ORDER BY md5('{seed}|{rule.rule_id}|' || tok)) AS rk,
                      count(*) OVER () AS elig FROM base WHERE {where}""",
        "drawn": f"""SELECT * EXCLUDE (rk, elig), row_number() OVER (ORDER BY tok) - 1 AS idx, count(*) OVER () AS k
                     FROM ranked WHERE rk <= {share}""",
        "changes": f"SELECT *, {columns} FROM drawn",
        "dirty": f"SELECT b.* REPLACE ({replaced}) FROM base b LEFT JOIN changes c USING (tok)",
    }


def rotated_ctes(rule: Rule, seed: int, table: str) -> dict[str, str]:
    """Like ``drawn_ctes`` for a rotation of values among the drawn rows."""
    shift = rule.params["shift"]
    step = f"(CASE WHEN {shift} % d.k = 0 THEN 1 ELSE {shift} % d.k END)"
    base = drawn_ctes(rule, seed, table, {name: name for name in rule.columns})
    turned, columns = [], []
    for name in rule.columns:
        turned.append(f"one.{name} IS NOT DISTINCT FROM d.{name}")
        columns.append(f"CASE WHEN {' OR '.join(turned)} THEN two.{name} ELSE one.{name} END AS new_{name}")
    base["changes"] = f"""SELECT d.*, {', '.join(columns)} FROM drawn d
        JOIN drawn one ON one.idx = (d.idx + {step}) % d.k
        JOIN drawn two ON two.idx = (d.idx + {step} + 1) % d.k"""
    return base
