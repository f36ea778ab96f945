"""Shards of nearly equal bytes by sampled splitters.

Rows are ordered by (hash of the text, hash of the key, row number), so equal
texts stand side by side. A bounded sample, drawn with chances in proportion to a
row's share of all bytes and of all rows, gives splitters; what lies between two of
them is a range. Ranges are counted exactly, and those that hold too much are
sampled and split again. Their prefix sums then place each row in its shard.

Texts of equal content share a shard unless their group alone is more than
``GROUP_SHARE`` of one; such a group is cut where the sizes ask for it. Null keys and
texts, empty texts and repeated rows are rows like any other (a null text has no
bytes). An empty table has an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendwell.session import cut_lineage

SHARDS = 16
# Splitters are gathered on the driver: a range holds some 200,000 rows, within these bounds.
ROWS_A_RANGE, LEAST_RANGES, MOST_RANGES = 200_000, 1024, 65_536
GROUP_SHARE = 0.02
LOWEST = -(1 << 63)
TURNS = 8  # a range still overfull then is placed as it is, by one task


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: bool = False) -> DataFrame:
    """``row``, ``key``, ``size`` (UTF-8 bytes and 1 more), ``crc`` and the order ``hash``, ``key_hash``."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("crc"),
        F.xxhash64(data).alias("hash"), F.xxhash64(F.col(key)).alias("key_hash"),
        *([F.struct("*").alias("rest")] if carry else []))


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """Number of splitters at or below a row."""
    table = np.array(splitters, dtype=np.int64).reshape(-1, 3)
    heads = table[:, 0].copy()
    inner = np.unique(heads[(table[:, 1:] != LOWEST).any(axis=1)])  # hashes whose own rows are split

    @F.pandas_udf("int")
    def place(head: pd.Series, second: pd.Series, third: pd.Series) -> pd.Series:
        head, second, third = head.to_numpy(), second.to_numpy(), third.to_numpy()
        found = np.searchsorted(heads, head, side="right")
        for own in np.intersect1d(head, inner):
            first, last = np.searchsorted(heads, own), np.searchsorted(heads, own, side="right")
            hit = np.flatnonzero(head == own)
            tag = np.repeat([0, 1], [last - first, len(hit)])  # splitters go before rows equal to them
            order = np.lexsort((tag, np.append(table[first:last, 2], third[hit]), np.append(table[first:last, 1], second[hit])))
            below = np.empty(len(order), np.int64)
            below[order] = np.cumsum(tag[order] == 0)
            found[hit] = first + below[last - first:]
        return pd.Series(found.astype(np.int32))

    return place("hash", "key_hash", "row")


def find_ranges(rows: DataFrame, total: int, count: int) -> tuple[list[tuple[int, int, int]], list]:
    """Splitters, and (range, bytes, rows) of each range that has rows."""
    wanted = min(max(LEAST_RANGES, count // ROWS_A_RANGE), MOST_RANGES)
    limit_bytes, limit_rows = max(2 * total // wanted, 1), max(2 * count // wanted, 1)
    # a row beyond the limit cannot be split: it neither makes its range overfull nor draws the sample to itself
    size = F.least(F.col("size"), F.lit(limit_bytes))
    splitters: list[tuple[int, int, int]] = []
    chosen, weight, turn = F.lit(True), 1.0, 0
    while True:
        share = (size / F.lit(float(total)) + F.lit(1.0 / count)) / F.lit(2.0 * weight)
        drawn = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share * (2 * wanted)
        ranged = rows.withColumn("range", _range_of(splitters))
        fresh = ranged.filter(chosen & drawn).select("hash", "key_hash", "row", "range")
        found = [tuple(r) for r in fresh.collect()]  # about 2 * wanted rows
        new = {(h, LOWEST, LOWEST) for h, _, _, r in found} if turn == 0 else {
            (h, k, n) if r in single else (h, LOWEST, LOWEST) for h, k, n, r in found}
        splitters = sorted(set(splitters) | new)
        stats = rows.groupBy(_range_of(splitters).alias("range")).agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.sum(size).alias("capped"), F.max("size").alias("largest"),
            F.min("hash").alias("least"), F.max("hash").alias("most")).collect()
        over = [s for s in stats if s["rows"] > 1 and (s["bytes"] - s["largest"] > limit_bytes or s["rows"] > limit_rows)]
        turn += 1
        if not over or turn == TURNS:
            return splitters, sorted((s["range"], s["bytes"], s["rows"]) for s in stats)
        single = {s["range"] for s in over if s["least"] == s["most"]}
        chosen = F.col("range").isin([s["range"] for s in over])
        weight = sum(s["capped"] / total + s["rows"] / count for s in over) / 2


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds ``shard`` and ``slot`` to what ``measured`` gave; ``slot`` counts the rows of a shard from 0."""
    rows = cut_lineage(rows)
    sums = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not sums["rows"]:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    total = sums["bytes"]
    splitters, ranges = find_ranges(rows.drop("rest"), total, sums["rows"])
    starts, bytes_before, rows_before = [], 0, 0
    for place, size, count in ranges:
        starts.append((place, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + size, rows_before + count
    starts = rows.sparkSession.createDataFrame(starts, "range int, bytes_before long, rows_before long")
    within = Window.partitionBy("range").orderBy("hash", "key_hash", "row")
    group = Window.partitionBy("range", "hash")
    placed = rows.withColumn("range", _range_of(splitters)).join(F.broadcast(starts), "range").select(
        "*", F.row_number().over(within).alias("nth"),
        F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    placed = placed.select(
        "*", F.sum("size").over(group).alias("group_bytes"), F.max("upto").over(group).alias("group_upto"))
    small = F.col("group_bytes") <= F.lit(GROUP_SHARE * total / shards)
    middle = F.col("bytes_before") + F.when(small, F.col("group_upto") - F.col("group_bytes") / 2).otherwise(
        F.col("upto") - F.col("size") / 2)
    shard = F.least(F.floor(middle * shards / F.lit(float(total))).cast("int"), F.lit(shards - 1))
    placed = cut_lineage(placed.select(
        *rows.columns, shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("at")))
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("at") - F.col("first")).drop("at", "first")


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    return assign(measured(docs, text, key), shards).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", shards: int = SHARDS) -> None:
    """All columns of ``docs`` as Parquet under ``path``, one folder a shard, each in the order of its slots.

    A shard is written by several tasks, which take 1,000,000 slots each.
    """
    placed = assign(measured(docs, text, key, carry=True), shards)
    part = F.floor(F.col("slot") / 1_000_000)
    placed.withColumn("_part", part).repartition("shard", "_part").sortWithinPartitions("shard", "slot").select(
        F.col("shard").alias("_shard"), F.struct("rest.*").alias("row"), "slot",
    ).write.partitionBy("_shard").parquet(path)
