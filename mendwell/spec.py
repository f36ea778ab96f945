"""Driver-side descriptions: tables, their constraints, rules and scenarios.

These are small configuration objects. No data lives here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of a child table point at ``parent_columns`` of ``parent``."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSpec:
    """What Spark does not enforce: key, references, NOT NULL and CHECK domains.

    ``checks`` maps a check name to a SQL predicate that must not be false.
    """

    name: str
    primary_key: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    not_null: tuple[str, ...] = ()
    checks: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    """One kind of fault and how many rows it takes.

    ``count`` asks for exactly that many rows; ``one_in`` asks for one eligible
    row in that many, so that the number of faults grows with the table.
    """

    rule_id: str
    table: str
    columns: tuple[str, ...]
    transform: str
    count: int | None = None
    one_in: int | None = None
    where: str = ""
    extra_columns: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)
    error_type: str = ""
    severity: str = ""
    expected_action: str = ""
    recoverability: str = ""
    description: str = ""

    def __post_init__(self) -> None:
        if (self.count is None) == (self.one_in is None):
            raise ValueError(f"{self.rule_id}: give either count or one_in")

    @classmethod
    def from_dict(cls, item: Mapping[str, Any]) -> Rule:
        return cls(
            rule_id=item["rule_id"],
            table=item["table"],
            columns=tuple(item["columns"]),
            transform=item["transform"],
            count=None if item.get("count") is None else int(item["count"]),
            one_in=None if item.get("one_in") is None else int(item["one_in"]),
            where=item.get("where", ""),
            extra_columns=tuple(item.get("extra_columns", ())),
            params=dict(item.get("params", {})),
            error_type=item.get("error_type", ""),
            severity=item.get("severity", ""),
            expected_action=item.get("expected_action", ""),
            recoverability=item.get("recoverability", ""),
            description=item.get("description", ""),
        )


@dataclass(frozen=True)
class ControlScope:
    """Columns of a table whose untouched cells may serve as clean controls."""

    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Scenario:
    id: str
    name: str
    seed: int
    target_quality_score: float
    rules: tuple[Rule, ...]
    control_scope: tuple[ControlScope, ...] = ()
    difficulty: str = ""
    description: str = ""

    @classmethod
    def from_dict(cls, item: Mapping[str, Any]) -> Scenario:
        return cls(
            id=item["id"],
            name=item.get("name", item["id"]),
            seed=int(item["seed"]),
            target_quality_score=float(item["target_quality_score"]),
            rules=tuple(Rule.from_dict(rule) for rule in item["rules"]),
            control_scope=tuple(
                ControlScope(scope["table"], tuple(scope["columns"]))
                for scope in item.get("control_scope", ())
            ),
            difficulty=item.get("difficulty", ""),
            description=item.get("description", ""),
        )

    def rule(self, rule_id: str) -> Rule:
        for rule in self.rules:
            if rule.rule_id == rule_id:
                return rule
        raise KeyError(rule_id)


def load_scenarios(path: str) -> dict[str, Scenario]:
    """Read scenarios from a JSON config file, wherever they sit in the document.

    Any JSON object that has a ``rules`` list is taken as a scenario and is
    returned under its ``id``.
    """
    with open(path, encoding="utf-8") as stream:
        document = json.load(stream)

    def walk(node: Any) -> Iterator[Mapping[str, Any]]:
        if isinstance(node, dict):
            if isinstance(node.get("rules"), list):
                yield node
            else:
                for child in node.values():
                    yield from walk(child)

    return {item["id"]: Scenario.from_dict(item) for item in walk(document)}


class Dataset(dict[str, DataFrame]):
    """Tables by name, with the spec of each."""

    def __init__(self, tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]):
        super().__init__(tables)
        self.specs = dict(specs)

    def with_table(self, name: str, df: DataFrame) -> Dataset:
        return Dataset({**self, name: df}, self.specs)

    def with_tables(self, tables: Mapping[str, DataFrame]) -> Dataset:
        return Dataset({**self, **tables}, self.specs)
