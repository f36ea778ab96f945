"""Metrics, gate, comparison and recommendations on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from mendwell.operators import compare, constraints, profile, recommend, repair, score
from mendwell.spec import Dataset, ForeignKey, TableSpec

SPEC = TableSpec("t", ("id",), not_null=("a",), checks={"b is positive": "b > 0"})
RECORD = (
    "op_seq bigint, rule_id string, operation string, table string, primary_key string, column string, "
    "clean_value string, corrupted_primary_key string"
)
CONTROL = "control_id string, table string, primary_key string, column string, clean_value string"


def _t(spark, rows):
    return Dataset({"t": spark.createDataFrame(rows, "id int, a string, b double")}, {"t": SPEC})


def _key(number):
    return f'{{"id":{number}}}'


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([
        (1, "r1", "update_cell", "t", _key(1), "a", "x", None),
        (2, "r1", "update_cell", "t", _key(2), "a", None, None),     # a NULL label
        (3, "r2", "update_cell", "t", _key(3), "id", "3", _key(103)),
        (4, "r3", "insert_row", "t", _key(9), None, None, None),
    ], RECORD)


@pytest.fixture
def kept(spark):
    return spark.createDataFrame([("c1", "t", _key(4), "b", "2.5"), ("c2", "t", _key(4), "a", None)], CONTROL)


def test_a_dirty_dataset_scores_its_controls_only(spark, labels, kept):
    dirty = _t(spark, [(1, "?", 1.0), (2, "?", 1.0), (103, "z", 1.0), (4, None, 2.5), (9, "x", 1.0)])
    row = score.quality(dirty, labels, kept).first()
    assert (row["quality_score"], row["repair_accuracy"], row["control_preservation"]) == (33.3333, 0.0, 100.0)
    assert (row["remaining_faults"], row["missing_rows"]) == (4, 0)  # the moved row is found by its corrupted key


def test_restoring_labels_scores_full_marks(spark, labels, kept):
    dirty = _t(spark, [(1, "?", 1.0), (2, "?", 1.0), (103, "z", 1.0), (4, None, 2.5), (9, "x", 1.0)])
    steps = [repair.Step("r1", "restore", columns=("a",)), repair.Step("r2", "restore", columns=("id",)), repair.Step("r3", "delete")]
    fixed = repair.repair_all(dirty, labels, steps)
    assert sorted(map(tuple, fixed["t"].collect()), key=str) == [(1, "x", 1.0), (2, None, 1.0), (3, "z", 1.0), (4, None, 2.5)]
    row = score.quality(fixed, labels, kept).first()
    assert (row["quality_score"], row["false_positives"]) == (100.0, 0)
    by_rule = {r["rule_id"]: r["repair_accuracy"] for r in score.quality_by(dirty, labels, ["rule_id"]).collect()}
    assert by_rule == {"r1": 0.0, "r2": 0.0, "r3": 0.0}


def test_a_broad_repair_harms_controls(spark, labels, kept):
    broad = _t(spark, [(1, "x", 1.0), (2, None, 1.0), (3, "z", 1.0), (4, "filled", 2.5)])
    row = score.quality(broad, labels, kept).first()
    assert (row["quality_score"], row["repair_accuracy"], row["control_preservation"]) == (83.3333, 100.0, 50.0)


def test_deleting_rows_does_not_repair_them(spark, labels, kept):
    row = score.quality(_t(spark, [(4, None, 2.5)]), labels, kept).first()
    assert (row["repaired_faults"], row["missing_rows"]) == (1, 3)


def test_nothing_to_score_is_perfect(spark, labels, kept):
    row = score.quality(_t(spark, [(1, "x", 1.0)]), labels.limit(0), kept.limit(0)).first()
    assert (row["quality_score"], row["repair_accuracy"], row["control_preservation"]) == (100.0, 100.0, 100.0)


def test_a_wrong_derivation_is_refused(spark):
    labels = spark.createDataFrame([(1, "r", "update_cell", "t", _key(1), "b", "5.0", None)], RECORD)
    dirty = _t(spark, [(1, "x", -5.0)])
    right = repair.Step("r", "derive", lambda v, _: F.abs(v), F.col("b") < 0, ("b",))
    wrong = repair.Step("r", "derive", lambda v, _: v - 1, F.col("b") < 0, ("b",))
    report = repair.run_steps(dirty, labels, [right]).report.first()
    assert (report["candidates"], report["before"], report["after"]) == (1, 1, 0)
    with pytest.raises(repair.RepairError):
        repair.run_steps(dirty, labels, [wrong])
    with pytest.raises(repair.RepairError):  # the row is not there
        repair.run_steps(_t(spark, [(2, "x", -5.0)]), labels, [repair.Step("r", "restore", columns=("b",))])


def test_the_gate_opens_only_for_a_perfect_result(spark, labels, kept):
    clean = _t(spark, [(1, "x", 1.0), (2, None, 1.0), (3, "z", 1.0), (4, None, 2.5)])
    none = spark.createDataFrame([("t", "c", 0)], "table string, constraint string, violations bigint")
    some = spark.createDataFrame([("t", "c", 1)], "table string, constraint string, violations bigint")
    same = compare.compare_datasets(clean, clean)
    marks = score.quality(clean, labels, kept)
    assert score.gate(marks, none, same).first()["passed"]
    assert not score.gate(marks, some, same).first()["passed"]
    other = compare.compare_datasets(clean, _t(spark, [(1, "x", 1.0)]))
    assert not score.gate(marks, none, other).first()["passed"]
    rows = score.summary({"a": score.gate(marks, none, same), "b": score.gate(marks, some, same)}).collect()
    assert {r["scenario"]: (r["passed"], r["all_passed"]) for r in rows} == {"a": (True, False), "b": (False, False)}


def test_constraints(spark):
    parent = TableSpec("p", ("k",))
    child = TableSpec("t", ("id",), (ForeignKey(("a",), "p", ("k",)),), ("a",), {"b is positive": "b > 0"})
    data = Dataset({
        "t": spark.createDataFrame([(1, "x", 1.0), (1, "y", -1.0), (None, None, None)], "id int, a string, b double"),
        "p": spark.createDataFrame([("x",)], "k string"),
    }, {"t": child, "p": parent})
    got = {(r["table"], r["constraint"]): r["violations"] for r in constraints.constraint_violations(data).collect()}
    assert got == {
        ("t", "key is not null"): 1, ("t", "not null a"): 1, ("t", "check b is positive"): 1, ("t", "key is unique"): 1,
        ("p", "key is not null"): 0, ("p", "key is unique"): 0,
    }
    lost = constraints.reference_violations(data).collect()
    assert [(r["constraint"], r["violations"]) for r in lost] == [("reference a -> p", 1)]


def test_fingerprints_ignore_layout_and_notice_cells(spark):
    rows = [(i, f"n{i}", float(i)) for i in range(100)]
    one = _t(spark, rows)["t"]
    print_of = lambda df: compare.fingerprint(df).first()["fingerprint"]
    assert print_of(one) == print_of(one.repartition(5).orderBy(F.desc("id")))
    assert print_of(one) != print_of(one.withColumn("a", F.when(F.col("id") == 7, "?").otherwise(F.col("a"))))
    assert print_of(one) != print_of(one.unionByName(one.limit(1)))
    assert print_of(one.limit(0)) == "0:0:0:0:0"


def test_differences_by_row_cell_and_schema(spark):
    left = _t(spark, [(1, "x", 1.0), (2, None, 2.0), (3, "z", 3.0)])
    right = _t(spark, [(1, "x", 1.5), (2, None, 2.0), (4, "w", 4.0)])
    rows = {r["id"]: r["change"] for r in compare.row_diff(left["t"], right["t"], ["id"]).collect()}
    assert rows == {1: "changed", 3: "removed", 4: "added"}
    cells = sorted(map(tuple, compare.cell_diff(left["t"], right["t"], ["id"]).collect()))
    assert cells == [(1, "changed", "b", "1.0", "1.5"), (3, "removed", None, None, None), (4, "added", None, None, None)]
    other = Dataset({"t": right["t"].withColumn("b", F.col("b").cast("string")).withColumn("c", F.lit(1))}, {"t": SPEC})
    diff = {r["column"]: (r["left_type"], r["right_type"]) for r in compare.compare_schemas(left, other).collect()}
    assert diff == {"b": ("double", "string"), "c": (None, "int")}
    assert compare.compare_schemas(left, right).count() == 0


def test_an_input_must_be_the_one_expected(spark):
    data = _t(spark, [(1, "x", 1.0)])
    compare.check_input(data, compare.fingerprints(data))
    with pytest.raises(ValueError):
        compare.check_input(_t(spark, [(1, "y", 1.0)]), compare.fingerprints(data))


RULES = "rule_id string, table string, columns array<string>, error_type string, expected_action string"
GIVEN = "item_no int, rule_id string, table string, columns array<string>, error_type string, recommended_action string"


def test_recommendations(spark):
    expected = spark.createDataFrame([
        ("A", "t", ["x"], "missing", "Fill"), ("B", "t", ["y", "z"], "swap", "reverse"), ("C", "u", ["x"], "typo", "match"),
    ], RULES)
    given = spark.createDataFrame([
        (1, "A", None, None, None, " fill "),
        (2, None, "t", ["z", "y"], "swap", "drop"),
        (3, "A", None, None, None, "fill"),            # a repetition costs precision
        (4, "nonsense", "u", ["q"], "typo", "match"),
        (5, None, "u", ["q"], "typo", "match"),
    ], GIVEN)
    row = recommend.score_recommendations(given, expected).first()
    assert (row["detection_precision"], row["detection_recall"], row["action_accuracy"]) == (0.4, 0.6667, 0.3333)
    lists = [(r["list"], r["name"]) for r in recommend.recommendation_lists(given, expected).collect()]
    assert lists == [("detected", "A"), ("detected", "B"), ("missed", "C"), ("unknown", "nonsense"), ("unknown", "response-item-5")]
    none = recommend.score_recommendations(given.limit(0), expected).first()
    assert (none["detection_precision"], none["detection_recall"]) == (0.0, 0.0)


def test_one_changed_row_makes_the_comparison_read_its_bucket(spark):
    left = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"), F.concat(F.lit("t"), F.col("id")).alias("t"))
    right = left.filter("k <> 50").withColumn("v", F.when(F.col("k") == 77, -1).otherwise(F.col("v")))
    near, far = compare.changed_buckets(left, right, ["k"])
    assert {r["k"] for r in near.collect()} >= {50, 77} and near.count() <= 4 and far.count() <= 3
    assert sorted(map(tuple, compare.row_diff(left, right, ["k"]).collect())) == [(50, "removed"), (77, "changed")]
    assert sorted(map(tuple, compare.cell_diff(left, right.drop("t"), ["k"]).collect())) == [
        (50, "removed", None, None, None), (77, "changed", "v", "231", "-1")]
    assert all(side.count() == 0 for side in compare.changed_buckets(left, left, ["k"]))
    assert compare.row_diff(left, left.limit(0), ["k"]).count() == 20_000


def test_distinct_counts_in_their_own_types(spark):
    wide = 2**62
    rows = [(i % 50 if i % 7 else None, wide - i % 300 * 10**15, f"x{i % 9}" * (1 + i % 2 * 60), float(i % 4), date(2020, 1, 1 + i % 20), i % 3 > 0, [i % 5])
            for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b bigint, c string, d double, e date, f boolean, g array<int>").repartition(4)
    want = {name: len({str(r[n]) for r in rows if r[n] is not None}) for n, name in enumerate(df.columns)}
    made = profile.distinct_counts(df, df.columns)
    assert {r["column"]: r["distinct_count"] for r in made.collect()} == want
    assert {r["distinct_count"] for r in profile.distinct_counts(df.limit(0), df.columns).collect()} == {0}
    plan = profile.distinct_counts(df.select("a", "b", "e"), ["a", "b", "e"])._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan and plan.count("bitmap_construct_agg") == 2
