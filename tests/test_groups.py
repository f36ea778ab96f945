"""Group statistics with one group that holds a third of all rows."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mendwell.operators import context, detect, groups


@pytest.fixture(params=[5_000_000, 300], ids=["no hot group", "hot group"])
def heat(request, monkeypatch):
    monkeypatch.setattr(groups, "HOT_ROWS", request.param)


@pytest.fixture(scope="module")
def rows():
    random.seed(11)
    keys = ["hot"] * 1_000 + [random.choice("abcdefgh") for _ in range(1_900)] + [None] * 100
    return [(i, key, round(random.lognormvariate(2, 2), 2) if random.random() > 0.02 else None) for i, key in enumerate(keys)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id int, k string, v double").repartition(7).cache()


def test_statistics_come_back_to_every_row(heat, table, rows):
    stats = table.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = groups.with_group_stats(table, stats, ["k"], ["n", "top"]).collect()
    sizes = Counter(key for _, key, _ in rows)
    assert len(got) == len(rows)
    assert all(row["n"] == (sizes[row["k"]] if row["k"] is not None else None) for row in got)


def test_a_hot_group_is_spread_over_partitions(table, monkeypatch):
    monkeypatch.setattr(groups, "HOT_ROWS", 300)
    spark = table.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stats = table.groupBy("k").agg(F.count("*").alias("n"))
        joined = groups.with_group_stats(table, stats, ["k"], ["n"])
        placed = joined.select("k", F.spark_partition_id().alias("place")).collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    spread = Counter(row["place"] for row in placed if row["k"] == "hot")
    assert len(spread) > 4 and max(spread.values()) < 400
    assert any("hashpartitioning(k#" in line and "_spread" in line for line in plan.splitlines())


def test_quantiles_are_exact(heat, table, rows):
    wanted = {"q1": (1, 4), "mid": (1, 2), "q9": (9, 10), "all": (1, 1)}
    values = defaultdict(list)
    for _, key, value in rows:
        if key is not None and value is not None:
            values[key].append(value)
    got = {row["k"]: row for row in groups.group_quantiles(table.filter("k IS NOT NULL"), ["k"], "v", wanted).collect()}
    assert set(got) == set(values)
    for key, known in values.items():
        known.sort()
        assert got[key]["n"] == len(known)
        for name, (top, bottom) in wanted.items():
            assert got[key][name] == known[math.ceil(len(known) * top / bottom) - 1], (key, name)


def test_quantiles_of_a_large_group_with_outliers_and_ties(spark):
    values = [float(i % 977) for i in range(60_000)] + [1e15] * 5 + [-1e15]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double").repartition(8)
    got = groups.group_quantiles(df, ["k"], "v", {"mid": (1, 2), "high": (99, 100)}).first()
    known = sorted(values)
    assert got["mid"] == known[math.ceil(len(known) / 2) - 1]
    assert got["high"] == known[math.ceil(len(known) * 99 / 100) - 1]


def test_mode_prefers_the_smaller_of_equals(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", 5)], "k string, v int")
    got = {row["k"]: (row["mode"], row["mode_n"], row["n"]) for row in groups.group_mode(df, ["k"], "v").collect()}
    assert got == {"a": (1, 2, 4), "b": (5, 1, 1)}


def test_lookup_by_broadcast_and_by_shuffle(heat, table):
    parent = table.sparkSession.createDataFrame([("hot", 1), ("a", 2), ("b", 3)], "key string, v2 int")
    expected = sorted(map(str, table.join(parent, table.k == parent.key, "left").select("id", "k", "v2").collect()))
    for limit in (100, 0):
        got = groups.lookup(table, parent, {"k": "key"}, {"v2": "v2"}, broadcast_rows=limit)
        assert sorted(map(str, got.select("id", "k", "v2").collect())) == expected


def test_detectors_do_not_depend_on_heat(heat, table, rows, spark):
    sizes = Counter(key for _, key, _ in rows if key is not None)
    parents = spark.createDataFrame([("hot",), ("a",)], "key string")
    orphans = detect.orphans(table, ["id"], ["k"], parents, ["key"]).count()
    assert orphans == sum(n for key, n in sizes.items() if key not in {"hot", "a"})
    lost_hot = detect.orphans(table, ["id"], ["k"], parents.filter("key = 'a'"), ["key"]).count()
    assert lost_hot == orphans + sizes["hot"]
    pairs = table.withColumn("one", F.when(F.col("id") == 3, "x").otherwise("y"))
    rare = context.rare_pairs(pairs, ["id"], ["k"], "one", (1, 20)).collect()
    assert [row["id"] for row in rare] == [3]
    usual = context.unlike_mode(pairs, ["id"], ["k"], ["one"]).collect()
    assert [(row["id"], row["usual_one"]) for row in usual] == [(3, "y")]


def test_near_misses_against_brute_force(heat, spark):
    names = ["hot name"] * 700 + ["othre"] * 2 + ["other"] * 60 + ["hto name", "hot name?", "hot nmae", "hot gnome"] + ["cold"] * 400 + ["colder"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(row["name"], row["canonical_name"]) for row in context.near_miss_names(df, ["id"], "name").collect()}

    def swapped(a, b):
        return len(a) == len(b) and any(a == b[:i] + b[i + 1] + b[i] + b[i + 2:] for i in range(len(b) - 1)) and a != b

    counts = Counter(names)
    brute = {
        (a, b) for a in counts for b in counts
        if counts[b] > counts[a] and (counts[a] <= 3 or counts[a] * 10 <= counts[b]) and (swapped(a, b) or a == b + "?")
    }
    assert got == brute and len(brute) == 4


def test_swapped_columns_with_a_hot_word(heat, spark):
    cells = [("Bern", "CH")] * 900 + [("Rome", "IT")] * 50 + [("CH", "Bern"), ("IT", "Rome"), ("CH", "IT"), ("New", "Land")]
    df = spark.createDataFrame([(i, *cell) for i, cell in enumerate(cells)], "id int, city string, land string")
    got = sorted((row["city"], row["land"]) for row in detect.swapped_columns(df, ["id"], "city", "land").collect())
    assert got == [("CH", "Bern"), ("IT", "Rome")]


def test_quantiles_of_a_hot_group_of_equal_values(heat, spark):
    df = spark.createDataFrame([("a", 5.0)] * 900 + [("a", 1.0)] * 50 + [("b", 2.0)], "k string, v double").repartition(6)
    got = {r["k"]: (r["n"], r["mid"]) for r in groups.group_quantiles(df, ["k"], "v", {"mid": (1, 2)}).collect()}
    assert got == {"a": (950, 5.0), "b": (1, 2.0)}


def test_repeated_texts_with_one_hot_text(heat, spark):
    texts = ["same " * 200] * 500 + ["twice"] * 2 + [None] * 3 + [f"once {i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {row["id"]: row["rows_alike"] for row in detect.repeated_texts(df, ["id"], ["text"]).collect()}
    assert got == {**{i: 500 for i in range(500)}, 500: 2, 501: 2}


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e12])
def test_far_values_are_found_at_any_scale(spark, scale):
    values = [(i, "k", scale * (100 + i % 7)) for i in range(60)] + [(60, "k", scale * 1000), (61, "one", scale)]
    df = spark.createDataFrame(values, "id int, k string, v double")
    assert [r["id"] for r in context.far_from_mean(df, ["id"], ["k"], "v").collect()] == [60]


def test_orphans_of_a_small_and_a_large_parent(spark, monkeypatch):
    child = spark.createDataFrame([(i, i % 12 if i % 5 else None) for i in range(200)], "id int, fk int")
    parent = spark.range(10).selectExpr("CAST(id AS INT) AS pk")
    found = []
    for small in (True, False):
        monkeypatch.setattr(detect, "is_small", lambda df, small=small: small)
        found.append(sorted(map(tuple, detect.orphans(child, ["id"], ["fk"], parent, ["pk"]).collect())))
    assert found[0] == found[1] == [(i, i % 12) for i in range(200) if i % 5 and i % 12 > 9]


@pytest.mark.parametrize("scale", ["plain", "wild"])
def test_no_task_ranks_more_than_the_limit(spark, monkeypatch, scale):
    """Large groups are narrowed bin by bin; what is ranked in the end is counted."""
    rng = random.Random(3)
    wild = [float("inf"), float("-inf"), float("nan"), 5e-324, -5e-324, 1e-310, -0.0, 0.0, 1.7e308]
    values = [(k, float((i * 7919) % 3001)) for k, n in (("a", 3001), ("b", 40), ("c", 1)) for i in range(n)] + [(None, 1.0)]
    values += [("ties", 7.0)] * 500 + [("ties", 7.5)] * 20
    if scale == "wild":
        values += [("a", rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-305, 305)) for _ in range(2000)]
        values += [("a", v) for v in wild * 30]
    df = spark.createDataFrame(values, "k string, v double").repartition(5)
    marks = {"least": (1, 10_000), "low": (1, 4), "mid": (1, 2), "high": (97, 100), "top": (1, 1)}
    seen, rank = [], groups._in_window
    monkeypatch.setattr(groups, "_in_window", lambda rows, keys: seen.append(rows) or rank(rows, keys))
    got = {r["k"]: r for r in groups.group_quantiles(df, ["k"], "v", marks, rank_rows=50).collect()}
    left = seen[0].groupBy("k", "_name").agg(F.count("*").alias("n"), F.countDistinct("_v").alias("d")).collect()
    assert all(r["n"] <= 50 or r["d"] <= 4 for r in left) and {r["k"] for r in left} == {"a", "ties"}
    assert set(got) == {"a", "b", "c", "ties"}
    for key, row in got.items():
        own = sorted((v for k, v in values if k == key), key=lambda v: (math.isnan(v), v))
        for name, (top, bottom) in marks.items():
            want = own[-(-len(own) * top // bottom) - 1]
            assert row[name] == want or (math.isnan(want) and math.isnan(row[name])), (key, name)
        assert row["n"] == len(own)


def test_order_keys_keep_the_order(spark):
    rng = random.Random(6)
    values = [rng.choice((1, -1)) * rng.random() * 2.0 ** rng.randint(-1074, 1023) for _ in range(3000)]
    values += [s * 2.0**e * f for s in (1, -1) for e in range(-1022, 1023, 7) for f in (1, 1 - 2**-53, 1 + 2**-52)]
    values += [0.0, -0.0, float("inf"), float("-inf"), 5e-324, 1.7976931348623157e308]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", groups.order_key(F.col("v")).alias("k")).collect()
    ordered = sorted(rows, key=lambda r: r["v"])
    assert all(a["k"] <= b["k"] for a, b in zip(ordered, ordered[1:]))
    usual = {r["v"]: r["k"] for r in rows if 1e-300 < abs(r["v"]) < 1e308}
    assert len(set(usual.values())) > len(usual) // 2


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_similar_names_against_all_pairs(spark, monkeypatch, distance):
    monkeypatch.setattr(context, "INDEX_BLOCK", 3)
    rng = random.Random(8)
    names = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(150)] + ["a long name", "along name", "a lnog name", "x" * 90, "x" * 88]
    rows = [(i, n) for i, n in enumerate(n for n in names for _ in range(rng.choice([1, 1, 2, 5, 30])))] + [(-1, None)]
    counts = Counter(n for _, n in rows if n is not None)
    want = set()
    for a, n in counts.items():
        near = [(-m, b) for b, m in counts.items() if m > n and (n <= 3 or n * 10 <= m) and 1 <= _edits(a, b) <= distance]
        want |= {(a, min(near)[1])} if near else set()
    df = spark.createDataFrame(rows, "id int, name string")
    got = context.similar_names(df, ["id"], "name", distance).collect()
    assert {(r["name"], r["canonical_name"]) for r in got} == want and len(want) > 10
    assert len(got) == sum(counts[a] for a, _ in want)
    assert context.similar_names(df.limit(0), ["id"], "name").collect() == []


def test_the_index_of_deletions_is_never_broadcast(spark):
    """A name becomes some 170 rows, which the size of the table of names does not show."""
    df = spark.createDataFrame([(i, f"Customer {i % 7:04d}") for i in range(40)], "id int, name string")
    plan = context.similar_names(df, ["id"], "name")._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in line and "_key" in line for line in plan.splitlines())
    assert not any("BroadcastHashJoin" in line and "_key" in line and "_block" in line for line in plan.splitlines())
