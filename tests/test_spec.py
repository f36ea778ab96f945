import json

import pytest

from mendwell.spec import Rule, load_scenarios


def _scenario(**more):
    rule = {"rule_id": "R", "table": "t", "columns": ["c"], "count": 3, "transform": "null", "error_type": "missing_value",
            "severity": "low", "expected_action": "fill", "recoverability": "oracle_required", "description": "d", **more}
    return {"id": "S", "name": "n", "seed": 7, "target_quality_score": 50.0, "difficulty": "easy",
            "control_scope": [{"table": "t", "columns": ["c", "d"]}], "rules": [rule]}


def test_scenarios_are_found_wherever_they_sit(tmp_path):
    path = tmp_path / "scenarios.json"
    path.write_text(json.dumps({"schema_version": "1.0", "levels": {"1": _scenario(where="c > 0", params={"factor": 2})}}))
    scenario = load_scenarios(str(path))["S"]
    assert scenario.seed == 7 and scenario.control_scope[0].columns == ("c", "d")
    rule = scenario.rule("R")
    assert (rule.count, rule.one_in, rule.where, rule.params) == (3, None, "c > 0", {"factor": 2})
    with pytest.raises(KeyError):
        scenario.rule("missing")


def test_a_rule_needs_a_size():
    with pytest.raises(ValueError):
        Rule("R", "t", ("c",), "null")
    with pytest.raises(ValueError):
        Rule("R", "t", ("c",), "null", count=1, one_in=2)
