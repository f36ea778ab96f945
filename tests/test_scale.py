"""Steps that many queries share move and read little."""

import hashlib
import json

from pyspark.sql import functions as F

from mendwell import session
from mendwell.operators import compare, constraints, controls, detect, inject, repair, sampling, score
from mendwell.plans import reports, trade
from mendwell.spec import ControlScope, Dataset, Rule, Scenario, TableSpec

SPEC = TableSpec("t", ("id", "part"))


def _rows(df):
    return sorted(map(str, df.collect()))


def _table(spark, n=600):
    return spark.range(n).select(
        F.concat(F.lit("k"), "id").alias("id"), (F.col("id") % 7).alias("part"), F.col("id").alias("a"), (F.col("id") % 50).alias("b"))


def test_few_rows_find_bits_of_other_keys(spark):
    df = spark.range(100_000).select(F.col("id").cast("string").alias("a"))
    near, far = session.split_by(df, ["a"], df.filter("cast(a AS int) % 100 = 0"), 1_000)
    assert 1_000 <= near.count() < 1_000 + 100_000 / 40
    assert near.count() + far.count() == 100_000


def test_tables_in_between_are_written_small(spark):
    df = session.cut_lineage(_table(spark))
    assert all(name.endswith(".zstd.parquet") for name in df.inputFiles())
    assert _rows(df) == _rows(_table(spark))


def test_unique_keys_are_told_by_their_hashes(spark, monkeypatch):
    rows = [("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1), (None, 1), ("b", None), (None, None)]
    df = spark.createDataFrame(rows, "id string, part int").unionByName(_table(spark).select("id", F.col("part").cast("int").alias("part")))
    assert constraints._maybe_alike(df, SPEC.primary_key).count() == 5

    def surplus():
        found = constraints.constraint_violations(Dataset({"t": df}, {"t": SPEC}))
        return found.filter("constraint = 'key is unique'").first()["violations"]

    assert surplus() == 3
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)  # much is left: the keys themselves are counted
    assert constraints._maybe_alike(df, SPEC.primary_key) is df and surplus() == 3


def test_controls_are_sought_out_once(spark, monkeypatch):
    data = Dataset({"t": _table(spark)}, {"t": SPEC})
    scenario = Scenario("s", "s", 5, 50.0, (Rule("r", "t", ("b",), "negative", count=60),), (ControlScope("t", ("a", "b")),))
    made = inject.inject(data, scenario)
    wanted = _rows(controls.draw_controls(data, scenario, made.journal, made.faults))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    scans, split_by = [], session.split_by
    monkeypatch.setattr(session, "split_by", lambda *some: scans.append(1) or split_by(*some))
    assert _rows(controls.draw_controls(data, scenario, made.journal, made.faults)) == wanted and len(wanted) > 50
    assert not scans


def test_drawn_rows_are_sought_out_once(spark, monkeypatch):
    data = _table(spark)
    rules = [(no, Rule(f"r{no}", "t", (column,), "rotate_values", count=20)) for no, column in enumerate(("a", "b"))]
    cuts = dict(enumerate(sampling.find_cuts(data, [inject._wish(data, rule, SPEC, 3) for _, rule in rules])))
    calls, drawn = [], inject._drawn
    monkeypatch.setattr(inject, "_drawn", lambda *some: calls.append(1) or drawn(*some))
    same, changed, journal = inject.drawn_apart(data, rules, SPEC, 3, cuts)
    assert len(calls) == len(rules)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (changed, *journal)]
    assert not any("Range" in plan for plan in plans)  # the table itself is read for the rest alone
    assert same.count() + changed.count() == 600 and 20 < changed.count() <= 40


def test_fingerprints_are_sums_of_integers(spark):
    df = _table(spark).withColumn("b", F.when(F.col("a") % 3 > 0, F.col("b")))
    texts = [json.dumps([None if v is None else str(v) for v in row], separators=(",", ":")) for row in df.collect()]
    hashes = [hashlib.sha256(text.encode()).hexdigest() for text in texts]
    wanted = ":".join(str(v) for v in (600, *(sum(int(h[15 * no:15 * no + 15], 16) for h in hashes) for no in range(4))))
    found = compare.fingerprint(df)
    assert found.first()["fingerprint"] == wanted
    assert "decimal(28,0)" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert compare.fingerprint(df.limit(0)).first()["fingerprint"] == "0:0:0:0:0"


def test_sides_beyond_the_limit_are_not_broadcast_by_their_size_on_disk(spark, monkeypatch):
    few, many = spark.range(100), spark.range(300)
    keyed = _table(spark).withColumn("key", F.lit("k"))
    records = keyed.select(F.col("id").alias("primary_key"), F.when(F.col("a") < 50, F.col("id")).alias("corrupted_primary_key"))
    data = Dataset({"t": keyed}, {"t": SPEC})
    wanted = keyed.select(F.lit("t").alias("table"), F.to_json(F.struct("id", "part")).alias("primary_key"), F.lit("a").alias("column"))
    wanted = wanted.withColumn("clean_value", F.lit("1"))

    def joins(limit):
        monkeypatch.setattr(session, "BROADCAST_ROWS", limit)
        found = (
            few.join(session.small_side(many), "id"),
            session.meet(few, many, ["id"]),
            detect.orphan_values(few, ["id"], many, ["id"]),
            repair._relocated(records, 50),
            score.current_cells(data, wanted),
        )
        return [df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") for df in found]

    assert joins(1_000) == [0] * 5  # by their size on disk all of them are small
    assert all(joins(10))


def test_faults_are_journalled_from_the_drawn_rows(spark):
    data = _table(spark).withColumn("c", F.col("a") + 1)
    rules = [(0, Rule("plain", "t", ("a",), "negative", count=30, where="a > 0")), (1, Rule("turned", "t", ("b",), "rotate_values", count=20)),
             (2, Rule("again", "t", ("a",), "multiply", one_in=9, params={"factor": 3})), (3, Rule("none", "t", ("c",), "null", count=0))]
    after, journal, cuts = inject.apply_rules(data, rules, SPEC, 3)
    assert [cuts[no].taken for no in (0, 1, 3)] == [30, 20, 0]
    assert not any("Range" in records._jdf.queryExecution().optimizedPlan().toString() for records in journal)
    found = journal[0].unionByName(journal[1]).unionByName(journal[2])
    changed = {(r["primary_key"], r["column"], r["clean_value"], r["corrupted_value"]) for r in found.collect()}
    old, new = ({(r["id"], r["part"]): r for r in df.select(*data.columns).collect()} for df in (data, after))
    assert changed == {
        (json.dumps({"id": key[0], "part": key[1]}, separators=(",", ":")), name, str(old[key][name]), str(new[key][name]))
        for key in old for name in ("a", "b") if old[key][name] != new[key][name]}


def test_drawn_rows_come_with_their_cuts(spark, monkeypatch):
    data = _table(spark).withColumn("h", sampling.draw_hash(1, "x", F.col("id")))
    draws = [sampling.Draw("some", F.col("b") > 10, F.col("h"), one_in=4), sampling.Draw("none", F.lit(True), F.col("h"), count=0),
             sampling.Draw("all", F.col("b") == 3, F.md5("h"), one_in=1)]
    cuts, drawn = sampling.draw_rows(data, draws, ["m0", "m1", "m2"])
    assert cuts == sampling.find_cuts(data, draws)
    for draw, cut, mark in zip(draws, cuts, ("m0", "m1", "m2")):
        assert _rows(drawn.filter(mark).select("id")) == _rows(data.filter(draw.eligible & cut.contains(draw.hashed)).select("id"))
    assert drawn.filter("NOT (m0 OR m1 OR m2)").isEmpty()
    monkeypatch.setattr(sampling, "_band", lambda cut, span, widen, real=sampling._band: real(cut, span, widen) if widen > 8 else ("0", "1"))
    again, same = sampling.draw_rows(data, draws, ["m0", "m1", "m2"])  # the first bands miss
    assert again == cuts and _rows(same) == _rows(drawn)


def test_only_cells_near_the_cut_leave_their_row(spark):
    data = Dataset({"t": _table(spark).withColumn("b", F.when(F.col("a") % 3 > 0, F.col("b")))}, {"t": SPEC})
    scenario = Scenario("s", "s", 5, 50.0, (), (ControlScope("t", ("a", "b")),))
    cells = controls._cells_in_scope(data, scenario.control_scope).withColumn(
        "h", sampling.draw_hash(5 + controls.CONTROL_SEED_STEP, "controls", F.concat_ws("|", "table", "primary_key", "column")))
    for span in (0.1, 1.0):
        found = controls._cells_below(data, scenario, span)
        assert found.columns == cells.columns and _rows(found) == _rows(cells.filter(F.col("h") < sampling.below(span)))
    assert found.count() == 1200


def test_scenarios_share_their_clean_tables(spark, tiny, monkeypatch):
    written, kept = [], trade.kept
    monkeypatch.setattr(trade, "kept", lambda spark, folder, name: written.append(name) or kept(spark, folder, name))
    found = reports._clean(spark, tiny, ("surface", "relational", "context"))
    assert written.count("orders") == written.count("lineitem") == written.count("priced") == 1
    assert found["surface"]["orders"] is found["context"]["orders"]
    assert "l_unitprice" in found["context"]["lineitem"].columns and "l_unitprice" not in found["relational"]["lineitem"].columns
    assert reports._clean(spark, tiny, ["context"])["context"]["lineitem"].columns == found["context"]["lineitem"].columns
