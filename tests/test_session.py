"""Joins of a table with keys beyond what is broadcast."""

import pytest
from pyspark.sql import functions as F

from mendwell import session
from mendwell.plans import trade


@pytest.mark.parametrize("words", [1 << 23, 512], ids=["room", "crowded"])
@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
def test_meeting_many_keys_equals_a_join(spark, monkeypatch, how, words):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 17 > 0, F.concat(F.lit("k"), F.floor(F.col("id") / 2))).alias("key"), "id")
    side = spark.range(0, 9_000, 3).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.create_map(F.lit("a"), "id").alias("m"))
    if how != "left":
        side = side.select("key")
    rows = lambda found: sorted(map(str, found.collect()))
    wanted = rows(df.join(side, "key", how))
    assert rows(session.meet(df, side, ["key"], how)) == wanted  # broadcast
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(session, "KEY_WORDS", words)
    assert rows(session.meet(df, side, ["key"], how)) == wanted
    assert rows(session.meet(df, side, ["key"], how, 3_000, side)) == wanted


def test_rows_without_a_key_there_stay(spark):
    df = spark.range(50_000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).alias("b"))
    keys = df.filter("cast(a AS int) % 100 = 0")
    near, far = session.split_by(df, ["a", "b"], keys, 500)
    assert near.count() < 500 + 50_000 / 10
    assert near.count() + far.count() == 50_000
    assert far.join(keys, ["a", "b"], "left_semi").isEmpty()


@pytest.mark.parametrize("name", ["priced", "orders"])
def test_a_lookup_that_shuffles_is_done_once(spark, tiny, monkeypatch, name):
    wanted = trade.table(spark, tiny, name)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    got = trade.kept(spark, tiny, name)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.schema.names == wanted.schema.names
    assert got.exceptAll(wanted).isEmpty() and got.count() == wanted.count()
