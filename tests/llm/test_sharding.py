import random
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import functions as F

from mendwell.llm import sharding


def check(rows, total_rows, near):
    assert len(rows) == total_rows
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))
    assert set(sizes) <= set(range(16))
    mean = sum(sizes.values()) / 16
    assert all(abs(sizes.get(s, 0) - mean) <= near for s in range(16))


def test_a_table_and_again(tiny_docs):
    rows = sharding.report(tiny_docs).collect()
    check(rows, tiny_docs.count(), max(r["size"] for r in rows))
    again = sharding.report(tiny_docs.repartition(5)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_hot_group_tiny_rows_and_equal_texts(spark):
    rows = [(i, "hot text " * 5) for i in range(2000)] + [(9000 + i, "") for i in range(2000)]
    rows += [(20_000 + i, f"text {i % 1500} " * (1 + i % 40)) for i in range(3000)]
    got = sharding.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    total = sum(r["size"] for r in got)
    check(got, len(rows), sharding.GROUP_SHARE * total / 16 + 800)
    texts, shards = dict(rows), defaultdict(set)
    for r in got:
        shards[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in shards.items() if len(t) > 60 and not t.startswith("hot"))


def counted_turns(monkeypatch):
    turns, plain = [], sharding._range_of

    def counting(splitters):
        turns.append(len(splitters))
        return plain(splitters)

    monkeypatch.setattr(sharding, "_range_of", counting)
    return turns


def test_one_huge_text_takes_few_turns(spark, monkeypatch):
    turns = counted_turns(monkeypatch)
    docs = spark.range(400_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") == 77, F.repeat(F.lit("0123456789"), 1_000_000)).otherwise(
            F.concat(F.lit("short "), F.col("id"))).alias("text"))
    got = sharding.report(docs).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert sum(r.n for r in got) == 400_000 and all(r.last == r.n - 1 for r in got)
    assert len(turns) <= 2 * 5 + 1  # two passes a turn, and the one that places the rows


def test_ranges_against_bisection(spark):
    rng = random.Random(4)
    low = sharding.LOWEST
    splitters = sorted({(h, low, low) for h in (1, 3, 5)} | {(3, rng.randint(-4, 4), rng.randint(-4, 4)) for _ in range(30)} | {(9, 2, 2)})
    rows = [(rng.randint(0, 10), rng.randint(-5, 5), rng.randint(-5, 5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "hash long, key_hash long, row long")
    got = df.select("*", sharding._range_of(splitters).alias("r")).collect()
    assert all(r.r == bisect_right(splitters, (r["hash"], r.key_hash, r.row)) for r in got)


def test_assignment_against_plain_placing(spark, odd_docs):
    """Shards and slots as one sort and running sums give them."""
    rows = [tuple(r) for r in sharding.measured(odd_docs).select("hash", "key_hash", "row", "size").collect()]
    rows.sort()
    total, at, want, groups = sum(r[3] for r in rows), 0, {}, defaultdict(list)
    for r in rows:
        at += r[3]
        groups[r[0]].append((r[2], at, r[3]))
    for members in groups.values():
        size = sum(m[2] for m in members)
        for row, upto, own in members:
            middle = members[-1][1] - size / 2 if size <= sharding.GROUP_SHARE * total / 16 else upto - own / 2
            want[row] = min(int(middle * 16 / total), 15)
    got = sharding.assign(sharding.measured(odd_docs)).collect()
    assert {r.row: r.shard for r in got} == want
    slots = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["hash"], r.key_hash, r.row)):
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = sharding.report(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, *_ in odd_rows)
    assert {r.text_crc32 for r in rows if r["size"] == 1} == {0}
    assert sharding.report(no_docs).count() == 0


def test_written_shards(odd_docs, odd_rows, tmp_path, spark):
    path = str(tmp_path / "shards")
    sharding.write_shards(odd_docs, path)
    back = spark.read.parquet(path)
    assert back.count() == len(odd_rows) and back.select("row.*").columns == odd_docs.columns
