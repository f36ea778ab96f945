import hashlib

import pytest
from pyspark.sql import functions as F

from mendwell.functions.text import key_token
from mendwell.operators import sampling


def _drawn(keys, seed, name, count):
    """Brute force: the keys with the smallest hashes, in text order."""
    tokens = {k: f'{{"id":{k}}}' for k in keys}
    ranked = sorted(keys, key=lambda k: hashlib.md5(f"{seed}|{name}|{tokens[k]}".encode()).hexdigest())
    return sorted(ranked[:count], key=lambda k: tokens[k])


@pytest.mark.parametrize("count", [0, 1, 7, 100, 2_999, 3_000])
def test_samples_have_the_exact_size(spark, count):
    df = spark.range(3_000)
    rows = sampling.deterministic_sample(df, ["id"], 5, "s", count=count).orderBy("sample_index").collect()
    assert [row["id"] for row in rows] == _drawn(range(3_000), 5, "s", count)
    assert [row["sample_index"] for row in rows] == list(range(count))


def test_a_share_counts_eligible_rows(spark):
    df = spark.range(1_000)
    rows = sampling.deterministic_sample(df, ["id"], 5, "s", one_in=30, where="id % 2 = 0").collect()
    assert sorted(row["id"] for row in rows) == sorted(_drawn(range(0, 1_000, 2), 5, "s", 500 // 30))


def test_too_few_eligible_rows(spark):
    with pytest.raises(sampling.NotEnoughRows):
        sampling.deterministic_sample(spark.range(10), ["id"], 1, "s", count=11)
    with pytest.raises(sampling.NotEnoughRows):
        sampling.deterministic_sample(spark.range(10).filter("id < 0"), ["id"], 1, "s", count=1)


def test_repeated_keys_cannot_be_drawn_exactly(spark):
    twice = spark.range(50).select((F.col("id") % 2).alias("id"))
    with pytest.raises(ValueError):
        sampling.deterministic_sample(twice, ["id"], 1, "s", count=3)


def test_a_missed_band_is_widened(spark, monkeypatch):
    monkeypatch.setattr(sampling.math, "sqrt", lambda _: -2.5)  # reach of one row
    hashes = spark.range(2_000).select(F.md5(F.col("id").cast("string")).alias("h"))
    cut = sampling.find_cut(hashes, count=700)
    assert hashes.filter(cut.contains(F.col("h"))).count() == 700


def test_numbering_many_rows_equals_numbering_few(spark):
    df = spark.range(0, 5_000, 1, 7).select((F.col("id") * 7919 % 5_003).alias("k"))
    few = sampling.with_index(df, ["k"], "n", 5_000)
    many = sampling.with_index(df, ["k"], "n", 5_000, one_task_rows=10)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    for name in ("_place", "_part", "_start", "__place", "n"):
        named = sampling.with_index(df.withColumn("_n", F.lit(1)), ["k"], name, 5_000, one_task_rows=10)
        assert named.columns == ["k", "_n", name]
        assert sorted((r["k"], r[name]) for r in named.collect()) == sorted(map(tuple, few.collect()))
    with pytest.raises(ValueError):
        sampling.with_index(df, ["k"], "k", 5_000)


def test_used_rows_are_left_out(spark):
    journal = spark.createDataFrame([("t", '{"id":1}', "a"), ("t", '{"id":2}', "b"), ("u", '{"id":3}', "a")], "table string, primary_key string, column string")
    rows = sampling.without_used(spark.range(5), ["id"], "t", ["a"], journal).collect()
    assert sorted(row["id"] for row in rows) == [0, 2, 3, 4]
    assert spark.range(1).select(key_token(["id"])).first()[0] == '{"id":0}'
