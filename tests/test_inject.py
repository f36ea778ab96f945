import pytest
from pyspark.sql import functions as F

from mendwell.functions import fixes
from mendwell.operators import controls, inject, repair, sampling
from mendwell.operators.compare import compare_datasets, logical_match
from mendwell.operators.score import quality
from mendwell.spec import ControlScope, Dataset, Rule, Scenario, TableSpec

SPECS = {"t": TableSpec("t", ("id",)), "named": TableSpec("named", ("code",))}


def _dataset(spark):
    t = spark.createDataFrame([(i, f"name {i % 7}", i % 3, i % 3 if i % 10 else None) for i in range(60)], "id bigint, a string, b int, c int")
    named = spark.createDataFrame([(f"K{i:02d}", f"N{i}") for i in range(20)], "code string, n string")
    return Dataset({"t": t, "named": named}, SPECS)


def _scenario(*rules):
    return Scenario("S", "s", 3, 50.0, tuple(rules), (ControlScope("t", ("a", "b")),))


def _records(made, rule_id):
    return made.journal.filter(F.col("rule_id") == rule_id).orderBy("op_seq").collect()


def test_rotation_against_a_loop(spark):
    data = _dataset(spark)
    rule = Rule("rot", "t", ("b", "c"), "rotate_values", count=40, params={"shift": 45})
    made = inject.inject(data, _scenario(rule))
    rows = {f'{{"id":{r["id"]}}}': r for r in data["t"].collect()}
    sample = [r["key_token"] for r in sampling.deterministic_sample(data["t"], ["id"], 3, "rot", count=40).orderBy("sample_index").collect()]
    expected = []
    shift = 45 % len(sample) or 1
    for place, token in enumerate(sample):
        donor = rows[sample[(place + shift) % len(sample)]]
        for column in ("b", "c"):
            new = donor[column]
            if new == rows[token][column]:
                donor = rows[sample[(place + shift + 1) % len(sample)]]
                new = donor[column]
            if new != rows[token][column]:
                text = [None if v is None else str(v) for v in (rows[token][column], new)]
                expected.append((token, column, *text))
    got = [(r["primary_key"], r["column"], r["clean_value"], r["corrupted_value"]) for r in _records(made, "rot")]
    assert got == expected and len(got) > 20


def test_rotation_of_fewer_than_two_rows_does_nothing(spark):
    made = inject.inject(_dataset(spark), _scenario(Rule("rot", "t", ("b",), "rotate_values", count=1, params={"shift": 1})))
    assert made.faults == 0
    assert made.rule_statistics.first()["generated_assertions"] == 0


def test_rules_see_the_result_of_earlier_ones_and_spare_used_cells(spark):
    first = Rule("one", "t", ("b",), "multiply", count=20, where="b >= 0", params={"factor": -1})
    second = Rule("two", "t", ("b",), "add", count=10, where="b <= 0", params={"increment": 50})
    made = inject.inject(_dataset(spark), _scenario(first, second))
    used = {r["primary_key"] for r in _records(made, "one")}
    # Zero times minus one changes nothing, so these cells stay free.
    assert len(used) < 20 and not used & {r["primary_key"] for r in _records(made, "two")}
    assert all(int(r["clean_value"]) <= 0 for r in _records(made, "two"))


def test_a_row_with_a_corrupted_key_is_out_of_reach(spark):
    move = Rule("move", "t", ("id",), "add", count=30, params={"increment": 1000})
    late = Rule("late", "t", ("a",), "null", count=30)
    made = inject.inject(_dataset(spark), _scenario(move, late))
    moved = {r["primary_key"]: r["corrupted_primary_key"] for r in _records(made, "move")}
    assert all(int(b[6:-1]) == int(a[6:-1]) + 1000 for a, b in moved.items())
    assert not set(moved) & {r["primary_key"] for r in _records(made, "late")}
    with pytest.raises(sampling.NotEnoughRows):
        inject.inject(_dataset(spark), _scenario(move, Rule("late", "t", ("a",), "null", count=31)))
    cells = controls.control_candidates(_dataset(spark), (ControlScope("t", ("a", "b")),), made.journal)
    assert cells.count() == 30  # 30 rows cannot be found, the others lost one of two cells


def test_clones_get_new_keys_of_the_keys_type(spark):
    rules = (
        Rule("text", "named", ("code",), "duplicate_rows", count=3, params={"new_pk_prefix": "D"}),
        Rule("number", "t", ("id",), "duplicate_rows", count=2, params={"new_pk_base": 800}),
    )
    made = inject.inject(_dataset(spark), _scenario(*rules))
    assert [r["primary_key"] for r in _records(made, "text")] == ['{"code":"D0001"}', '{"code":"D0002"}', '{"code":"D0003"}']
    assert [r["primary_key"] for r in _records(made, "number")] == ['{"id":801}', '{"id":802}']
    assert made.dataset["named"].count() == 23
    with pytest.raises(ValueError):
        spec = TableSpec("t", ("id", "a"))
        inject.apply_rule(_dataset(spark)["t"], rules[1], spec, 1)


def test_ids_are_dense_and_examples_come_first(spark):
    rules = (Rule("one", "t", ("a",), "typo", count=9), Rule("two", "named", ("n",), "null", count=2))
    made = inject.inject(_dataset(spark), _scenario(*rules))
    ids = [r["operation_id"] for r in made.journal.orderBy("op_seq").collect()]
    assert ids == [f"S-OP-{n:06d}" for n in range(1, 12)]
    plan = {r["rule_id"]: r for r in inject.plan_of(rules, made.journal).collect()}
    assert [e["op_seq"] for e in plan["one"]["examples"]] == [1, 2, 3]
    assert plan["two"]["affected_assertions"] == 2 and [e["op_seq"] for e in plan["two"]["examples"]] == [10, 11]


def test_equal_columns_are_not_swapped(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y", "x") for i in range(10)], "id bigint, a string, c string")
    rule = Rule("swap", "t", ("a", "c"), "swap_columns", count=10)
    made = inject.inject(Dataset({"t": df}, SPECS), Scenario("S", "s", 3, 50.0, (rule,)))
    assert made.faults == 10  # two cells of five rows


def test_undo_takes_the_earliest_value_and_follows_a_moved_key(spark):
    data = _dataset(spark)
    rules = (
        Rule("a", "t", ("a",), "null", count=50),
        Rule("b", "t", ("b",), "multiply", count=50, params={"factor": 7}),
        Rule("move", "t", ("id",), "add", count=50, params={"increment": 1000}),
        Rule("clone", "t", ("id",), "duplicate_rows", count=5, params={"new_pk_base": 5000}),
    )
    made = inject.inject(data, _scenario(*rules))
    undone = repair.undo_journal(made.dataset, made.journal)
    assert logical_match(compare_datasets(data, undone)).first()["logical_match"]
    twice = made.journal.filter("rule_id = 'a'").unionByName(
        made.journal.filter("rule_id = 'a'").withColumns({"op_seq": F.col("op_seq") + 1000, "clean_value": F.lit("later")})
    ).unionByName(made.journal.filter("rule_id <> 'a'"))
    again = repair.undo_journal(made.dataset, twice)
    assert logical_match(compare_datasets(data, again)).first()["logical_match"]


def test_controls_bring_the_raw_quality_to_its_target(spark):
    data = _dataset(spark)
    scenario = Scenario("S", "s", 3, 45.0, (Rule("a", "t", ("a",), "null", count=22),), (ControlScope("t", ("a", "b", "c")),))
    made = inject.inject(data, scenario)
    chosen = controls.draw_controls(data, scenario, made.journal, made.faults)
    assert chosen.count() == controls.controls_wanted(22, 45.0) == 18
    row = quality(made.dataset, made.journal, chosen).first()
    assert (row["quality_score"], row["remaining_faults"], row["preserved_controls"]) == (45.0, 22, 18)
    greedy = Scenario("S", "s", 3, 99.0, scenario.rules, scenario.control_scope)
    with pytest.raises(sampling.NotEnoughRows):
        controls.draw_controls(data, greedy, made.journal, made.faults)


def test_rules_that_depend_on_each_other_do_not_draw_together():
    def rule(name, columns, transform="null", where="", **params):
        return Rule(name, "t", tuple(columns.split()), transform, count=1, where=where, params=params)

    rules = [
        rule("1", "a"), rule("2", "b"),                      # together
        rule("3", "c", where="A IS NOT NULL"),               # reads a
        rule("4", "d", "date_before", source_column="c"),    # reads c
        rule("5", "e", where="x > 0"), rule("6", "x"),       # 6 writes what 5 reads
        rule("7", "id", "add"), rule("8", "f"),              # a corrupted key
        rule("9", "id", "duplicate_rows"), rule("10", "g"),  # more rows
    ]
    runs = inject.independent_runs(list(enumerate(rules)), SPECS["t"])
    assert [[r.rule_id for _, r in run] for run in runs] == [["1", "2"], ["3"], ["4", "5"], ["6", "7"], ["8", "9"], ["10"]]


def test_a_taken_key_is_refused(spark):
    with pytest.raises(ValueError, match="taken"):
        inject.inject(_dataset(spark), _scenario(Rule("clone", "t", ("id",), "duplicate_rows", count=3, params={"new_pk_base": 10})))
    made = inject.inject(_dataset(spark), _scenario(Rule("clone", "t", ("id",), "duplicate_rows", count=3)))
    keys = [r["id"] for r in made.dataset["t"].select("id").collect()]
    assert len(set(keys)) == len(keys) == _dataset(spark)["t"].count() + 3


@pytest.mark.parametrize("count", [4, 5, 6])
def test_a_key_with_several_rows_is_refused(spark, count):
    twice = spark.createDataFrame([(i % 10, f"x{i % 10}") for i in range(20)], "id bigint, a string")
    with pytest.raises(ValueError):
        inject.inject(Dataset({"t": twice}, SPECS), _scenario(Rule("a", "t", ("a",), "null", count=count)))


def test_64_bit_integers_stay_what_they_are(spark):
    big = 2**53
    table = spark.createDataFrame([(big + i, (big + i) * 7) for i in range(40)], "k bigint, v bigint")
    data = Dataset({"t": table}, {"t": TableSpec("t", ("k",))})
    rules = [Rule("times", "t", ("v",), "multiply", count=30, params={"factor": 100}, error_type="x"),
             Rule("key", "t", ("k",), "add", count=10, params={"increment": 100_000})]
    made = inject.inject(data, Scenario("S", "s", 3, 50.0, tuple(rules), ()))
    dirty = {r["k"]: r["v"] for r in made.dataset["t"].collect()}
    assert len(dirty) == 40 and sum(k >= big + 100_000 for k in dirty) == 10
    assert sorted(k % 100_000 - big % 100_000 for k in dirty) == list(range(40))
    assert sum(v >= 100 * big for v in dirty.values()) == 30
    steps = [repair.Step("key", "restore", columns=("k",)), repair.Step("times", "derive", lambda raw, _: fixes.undo_factor(raw), columns=("v",))]
    fixed = repair.repair_all(made.dataset, made.journal, steps)
    assert sorted(map(tuple, fixed["t"].collect())) == sorted(map(tuple, table.collect()))


def test_undone_factor_of_large_integers(spark):
    values = [(2**53 + 1 + i) * 100 for i in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert [r[0] for r in df.select(fixes.undo_factor(F.col("v")).cast("bigint")).collect()] == [v // 100 for v in values]


def test_results_beyond_64_bits_and_met_keys_are_refused(spark):
    data = _dataset(spark)
    wide = Rule("w", "t", ("b",), "multiply", count=5, where="b > 0", params={"factor": 10**19 // 2})
    with pytest.raises(Exception, match="beyond 64 bits"):
        inject.inject(Dataset({"t": data["t"].withColumn("b", F.col("b").cast("bigint"))}, {"t": SPECS["t"]}), _scenario(wide))
    with pytest.raises(ValueError, match="corrupted key"):
        inject.inject(data, _scenario(Rule("k", "t", ("id",), "add", count=30, params={"increment": 1})))


def test_undrawn_rows_pass_by_and_all_rules_share_a_join(spark, monkeypatch):
    monkeypatch.setattr(inject, "small_side", lambda df, *_: df)
    data = _dataset(spark)["t"].withColumns({"d": F.lit("x"), "e": F.lit("Some Name")})
    rules = [(0, Rule("one", "t", ("a",), "case_noise", count=9)), (1, Rule("two", "t", ("d",), "placeholder", count=8)),
             (2, Rule("three", "t", ("b", "c"), "rotate_values", count=7)), (3, Rule("four", "t", ("e",), "case_noise", count=6))]
    assert len(inject.independent_runs(rules, SPECS["t"])) == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = []
        for some in (rules[:1], rules):
            cuts = dict(zip([no for no, _ in some], sampling.find_cuts(data, [inject._wish(data, rule, SPECS["t"], 3) for _, rule in some])))
            same, changed, _ = inject.drawn_apart(data, some, SPECS["t"], 3, cuts)
            plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan(same) and "Join" not in plan(same)
            joins.append(plan(changed).count("SortMergeJoin"))
            assert changed.count() < 31 and same.count() + changed.count() == 60
        assert joins == [1, 1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    after, journal, _ = inject.apply_rules(data, rules, SPECS["t"], 3)
    alone = [inject.apply_rule(data, rule, SPECS["t"], 3) for _, rule in rules]
    for (no, rule), records in zip(rules, journal):
        assert sorted(map(str, records.drop("rule_no").collect())) == sorted(map(str, alone[no][1].drop("rule_no").collect()))
        for column in rule.columns:
            assert sorted(map(str, after.select("id", column).collect())) == sorted(map(str, alone[no][0].select("id", column).collect()))
