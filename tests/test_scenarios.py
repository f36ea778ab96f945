"""Inject, repair and score whole scenarios; everything must come back clean."""

import pytest
from pyspark.sql import functions as F

from mendwell import session
from mendwell.operators import compare, controls, groups, inject, repair, sampling, score
from mendwell.plans import scenarios, trade
from mendwell.spec import ControlScope, Dataset, Rule, Scenario, TableSpec


@pytest.mark.parametrize("name, tables", [*((name, "small") for name in scenarios.SCENARIOS), ("relational", "large")])
def test_round_trip(spark, tiny, monkeypatch, name, tables):
    if tables == "large":  # every switch that depends on sizes takes its other side
        monkeypatch.setattr(sampling, "ONE_TASK_ROWS", 10)
        monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
        monkeypatch.setattr(groups, "HOT_ROWS", 50)
    scenario = scenarios.SCENARIOS[name]
    clean = trade.dataset(spark, tiny, priced=name == "context")
    made = inject.inject(clean, scenario)
    chosen = controls.draw_controls(clean, scenario, made.journal, made.faults)
    raw = score.quality(made.dataset, made.journal, chosen).first()
    assert raw["quality_score"] == pytest.approx(scenario.target_quality_score, abs=0.05)
    assert (raw["repaired_faults"], raw["false_positives"]) == (0, 0)
    baseline = inject.raw_text_layer(clean, scenario.rules)

    fixed = repair.run_steps(made.dataset, made.journal, scenarios.STEPS[name]())
    assert all(row["after"] == 0 for row in fixed.report.collect())
    done = score.quality(fixed.dataset, made.journal, chosen).first()
    assert (done["quality_score"], done["remaining_faults"], done["false_positives"]) == (100.0, 0, 0)
    assert compare.logical_match(compare.compare_datasets(baseline, fixed.dataset)).first()["logical_match"]

    at_once = repair.repair_all(made.dataset, made.journal, scenarios.STEPS[name]())
    undone = repair.undo_journal(made.dataset, made.journal)
    for other in (at_once, undone):
        assert compare.logical_match(compare.compare_datasets(baseline, other)).first()["logical_match"]


def test_every_rule_has_a_step():
    for name, scenario in scenarios.SCENARIOS.items():
        assert {rule.rule_id for rule in scenario.rules} == {step.rule_id for step in scenarios.STEPS[name]()}


def test_journal_and_controls_beyond_one_task(spark):
    """More records than one task numbers, by the real limit."""
    rows = sampling.ONE_TASK_ROWS + 20_000
    table = spark.range(rows).select(F.col("id").alias("k"), (F.col("id") % 97).alias("v"), F.lit("a").alias("w"))
    data = Dataset({"t": table}, {"t": TableSpec("t", ("k",))})
    rule = Rule("r", "t", ("v",), "null", count=rows - 10)
    scenario = Scenario("S", "s", 5, 50.0, (rule,), (ControlScope("t", ("w",)),))
    made = inject.inject(data, scenario)
    chosen = controls.draw_controls(data, scenario, made.journal, made.faults)
    for df, number, prefix in ((made.journal, "operation_id", "S-OP-"), (chosen, "control_id", "S-CTRL-")):
        found = df.agg(F.count("*").alias("n"), F.countDistinct(number).alias("d"), F.max(F.substring(number, len(prefix) + 1, 9).cast("int")).alias("m")).first()
        assert tuple(found) == (rows - 10,) * 3
    assert made.journal.filter(F.col("op_seq").isNull()).isEmpty()


def test_steps_of_a_table_write_it_once(spark, tiny, monkeypatch):
    """One write and one join with labels a table, however many steps there are."""
    scenario = scenarios.SCENARIOS["surface"]
    made = inject.inject(trade.dataset(spark, tiny), scenario)
    steps = scenarios.STEPS["surface"]()
    writes, joins = [], []
    cut, slotted = repair.cut_lineage, repair._slotted
    monkeypatch.setattr(repair, "cut_lineage", lambda df: writes.append(df) or cut(df))
    monkeypatch.setattr(repair, "_slotted", lambda *args: joins.append(args) or slotted(*args))
    fixed = repair.run_steps(made.dataset, made.journal, steps)
    tables = {rule.table for rule in scenario.rules}
    assert len(writes) == len(joins) == len(tables) < len(steps)
    for df in writes:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1
    left = {r["rule_id"]: (r["before"], r["after"]) for r in fixed.report.collect()}
    counts = {r["rule_id"]: r["count"] for r in made.journal.groupBy("rule_id").count().collect()}
    assert left == {rule: (n, 0) for rule, n in counts.items()}
