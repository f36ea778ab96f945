import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from mendwell import session
from mendwell.operators.profile import distinct_counts, null_counts, storage_types
from mendwell.sources import dataset, files, manifest, publish
from mendwell.spec import TableSpec


def test_tables_load_in_several_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, a string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    df.write.json(str(tmp_path / "t.json"))
    for kind, options in (("parquet", {}), ("csv", {"header": "true"}), ("json", {})):
        loaded = dataset.load_dataset(spark, str(tmp_path), [TableSpec("t", ("id",))], kind, views=True, **options)
        assert loaded["t"].count() == 2 and spark.table("t").count() == 2
    raw = dataset.read_table(spark, str(tmp_path / "t.csv"), "csv", "id string, a string", header="true")
    assert dict(raw.dtypes) == {"id": "string", "a": "string"}


def test_raw_text_and_back(spark):
    df = spark.createDataFrame([(1.5,), (None,)], "v double")
    raw = dataset.raw_text(df, ["v"]).unionByName(spark.createDataFrame([("USD 2",)], "v string"))
    assert [r["v"] for r in dataset.typed(raw, {"v": "double"}).collect()] == [1.5, None, None]


def test_publishing_is_all_or_nothing(spark, tmp_path):
    out, tables = str(tmp_path / "out"), {"t": spark.range(3).toDF("id")}
    with pytest.raises(publish.PublishRefused):
        publish.publish(spark, tables, out, validate=lambda written: False)
    assert not publish.path_exists(spark, out) and list(tmp_path.iterdir()) == []
    publish.publish(spark, tables, out, validate=lambda written: written["t"].count() == 3)
    with pytest.raises(publish.PublishRefused):
        publish.publish(spark, tables, out)
    with pytest.raises(publish.PublishRefused):
        publish.publish(spark, tables, out, source=out, force=True)
    publish.publish(spark, {"t": spark.range(5).toDF("id")}, out, force=True)
    assert spark.read.parquet(f"{out}/t").count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_report_is_one_readable_file(spark, tmp_path):
    out = tmp_path / "report"
    publish.write_report(spark.createDataFrame([("é", None)], "a string, b string"), str(out))
    texts = [p.read_text(encoding="utf-8") for p in out.iterdir() if p.name.startswith("part-")]
    assert [json.loads(text) for text in texts] == [{"a": "é", "b": None}]
    with pytest.raises(publish.PublishRefused):
        publish.write_report(spark.range(1).toDF("a"), str(out))


def test_checksum_audit(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ab")
    (tmp_path / "b.txt").write_text("b")
    actual = files.file_checksums(spark, str(tmp_path), "*.txt")
    good = "fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603"
    expected = spark.createDataFrame([("a.txt", good), ("b.txt", good), ("c.txt", good)], "file string, sha256 string")
    got = {r["file"]: r["status"] for r in files.audit_checksums(actual, expected).collect()}
    assert got == {"a.txt": "ok", "b.txt": "mismatch", "c.txt": "missing"}


def test_a_manifest_document(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({
        "preprocessing_plan": [{
            "rule_id": "R", "location": {"table": "t", "columns": ["a"]}, "error_type": "typo",
            "preprocessing": {"expected_action": "match"}, "affected_assertions": 1,
        }],
        "repair_records": [
            {"operation_id": "1", "operation": "update_cell", "rule_id": "R", "table": "t", "primary_key": {"id": 5, "k": "x"},
             "column": "a", "clean_value": 2.5, "corrupted_value": "USD 2.5"},
            {"operation_id": "2", "operation": "insert_row", "rule_id": "Q", "table": "t", "primary_key": {"id": 6},
             "column": None, "clean_value": None, "corrupted_value": {"id": 6, "a": 1}},
        ],
        "clean_controls": [{"control_id": "C", "table": "t", "primary_key": {"id": 7}, "column": "a", "clean_value": None}],
        "validation_expectations": {"tables": {"t": {"rows": 9, "fingerprint": "f"}}},
    }, indent=2), encoding="utf-8")
    document = manifest.read_document(spark, str(path))
    rows = manifest.records_for(document.journal, "R").collect()
    assert [(r["op_seq"], r["primary_key"], r["clean_value"]) for r in rows] == [(1, {"id": "5", "k": "x"}, "2.5")]
    assert document.plan.first()["columns"] == ["a"] and document.controls.first()["clean_value"] is None
    assert tuple(document.expectations.first()) == ("t", 9, "f")


def test_the_cluster_names_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder.split(":")[-1] in session.checkpoint_folder(spark)
    kept = session.cut_lineage(spark.range(10).withColumn("t", F.lit("x")))
    assert kept.count() == 10 and any(folder.split(":")[-1] in path for path in kept.inputFiles())


def test_only_small_sides_are_broadcast(spark):
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(session.small_side(spark.range(5)))
        assert "BroadcastHashJoin" not in plan(session.small_side(spark.range(5), limit=4))
        assert "BroadcastHashJoin" not in plan(session.small_side(spark.range(5), rows=10**9))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_profile_counts(spark):
    df = spark.createDataFrame([("1", None), ("USD 2", "a"), ("1", "a"), (None, "b")], "x string, y string")
    assert {r["column"]: r["null_count"] for r in null_counts(df).collect()} == {"x": 1, "y": 1}
    for exact in (True, False):
        assert {r["column"]: r["distinct_count"] for r in distinct_counts(df, ["x", "y"], exact).collect()} == {"x": 2, "y": 2}
    kinds = {(r["column"], r["storage_type"]): r["cells"] for r in storage_types(df, ["x"]).collect()}
    assert kinds == {("x", "integer"): 2, ("x", "text"): 1, ("x", "null"): 1}


def test_large_files_are_hashed_as_streams(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 5_000_000)
    (tmp_path / "b.bin").write_bytes(b"y")
    whole = sorted(map(tuple, files.file_checksums(spark, str(tmp_path)).collect()))
    streamed = sorted(map(tuple, files.file_checksums(spark, str(tmp_path), whole_bytes=1).collect()))
    assert whole == streamed and [r[:2] for r in whole] == [("a.bin", 5_000_000), ("b.bin", 1)]


def test_broadcasts_look_at_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 1000, [1.0] * 9) for i in range(100)], "id int, text string, v array<double>")
    assert session.is_small(df) and not session.is_small(df, 99)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 50_000)
    assert not session.is_small(df) and session.is_small(df.select("id"))


def test_large_files_are_not_opened_by_the_driver(spark, tmp_path, monkeypatch):
    (tmp_path / "a b%20c.bin").write_bytes(b"x" * 9_000_000)
    monkeypatch.setattr(files, "_streamed", lambda *_: pytest.fail("opened by the driver"))
    monkeypatch.setattr(files, "WHOLE_BYTES", 1)
    made = files.file_checksums(spark, str(tmp_path))
    assert [tuple(r) for r in made.collect()] == [("a b%20c.bin", 9_000_000, sha256(b"x" * 9_000_000).hexdigest())]


def test_versions_and_a_failure_between_the_steps(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, out)
    with pytest.raises(publish.PublishRefused):
        publish.publish_version(spark, {"t": spark.range(1)}, out, validate=lambda written: False)
    for rows in (3, 4):
        publish.publish_version(spark, {"t": spark.range(rows), "u": spark.range(1)}, out, validate=lambda w: w["t"].count() > 2)
    assert {name: df.count() for name, df in publish.read_published(spark, out).items()} == {"t": 4, "u": 1}
    with monkeypatch.context() as patch:
        patch.setattr(publish, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            publish.publish_version(spark, {"t": spark.range(9)}, out)
    assert publish.read_published(spark, out)["t"].count() == 4
    reader = publish.read_published(spark, out)["t"]
    with monkeypatch.context() as patch:  # another one was faster
        patch.setattr(publish, "_pointers", lambda *_: [1])
        with pytest.raises(publish.PublishRefused):
            publish.publish_version(spark, {"t": spark.range(9)}, out)
    publish.publish_version(spark, {"t": spark.range(6)}, out)
    assert publish.read_published(spark, out)["t"].count() == 6 and reader.count() == 4
    assert len(list((tmp_path / "out" / "versions").iterdir())) == 2
