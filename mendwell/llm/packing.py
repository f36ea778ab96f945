"""Packing of documents into training sequences of several permitted lengths, by best fit.

Documents longer than the largest length are cut into pieces that fill sequences of
that length, and a rest. Rests and shorter documents are dealt into groups of a bounded size
by hash, and each group is packed by itself: pieces by decreasing length, each
into the open sequence where it leaves the least room. If none has room, a sequence is opened
of the length with the least cost for each word that it can expect to hold. Each
group is packed under several bounds on that length, the cheapest outcome stays, and in the
end every sequence is reduced to the least length that holds its contents.

A document without words has one row, of length 0 and in no sequence. Null keys and repeated
rows are documents like others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendwell.llm.mixing import words

LENGTHS = (256, 512, 1024, 2048, 4096)
GROUP_ROWS = 20_000
QUADRATIC = 1 / 16_384  # cost of a sequence of n words: n + QUADRATIC * n * n


def cost(length: float) -> float:
    return length + QUADRATIC * length * length


def pack(sizes: Sequence[int], permitted: Sequence[int]) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece; ``sizes`` decrease, ``permitted`` lengths increase."""
    left = int(sum(sizes))
    stacks: list[list[int]] = [[] for _ in range(permitted[-1] + 1)]
    open_rooms, used, place, offset = 0, [], [], []
    for size in sizes:
        left -= size
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = stacks[room].pop()
            if not stacks[room]:
                open_rooms ^= 1 << room
        else:
            room = min((c for c in permitted if c >= size), key=lambda c: cost(c) / (size + min(left, c - size)))
            number = len(used)
            used.append(0)
        place.append(number)
        offset.append(used[number])
        used[number] += size
        room -= size
        if room:
            if not stacks[room]:
                open_rooms |= 1 << room
            stacks[room].append(number)
    return place, offset


def best_pack(sizes: np.ndarray, permitted: Sequence[int] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and reduced length for each of the decreasing ``sizes``, at the least cost found."""
    best = None
    lengths = np.array(permitted)
    for bound in range(len(permitted)):
        own = [c for c in permitted if c <= permitted[bound]]
        if len(sizes) and sizes[0] > own[-1]:
            own = [c for c in permitted if c <= max(own[-1], int(lengths[np.searchsorted(lengths, sizes[0])]))]
        place, offset = map(np.array, pack(sizes.tolist(), own))
        filled = np.bincount(place, weights=sizes).astype(np.int64)
        reduced = lengths[np.searchsorted(lengths, filled)]
        price = sum(cost(int(c)) * n for c, n in zip(*np.unique(reduced, return_counts=True)))
        if best is None or price < best[0]:
            best = price, place, offset, reduced[place]
    return best[1:]


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", lengths: Sequence[int] = LENGTHS,
           group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row a piece: ``key``, ``piece`` (from 0), ``start`` and ``length`` in words of the document,
    ``sequence``, ``offset`` in it and its ``capacity``."""
    lengths = tuple(sorted(lengths))
    largest = lengths[-1]
    groups = max(1, -(-docs.count() // group_rows))
    sized = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), words(F.col(text)).alias("size"))
    full = F.floor(F.col("size") / largest).cast("int")
    sized = sized.withColumn("full", full).withColumn("group", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(groups)).cast("long"))
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("piece")).withColumn(
        "length", F.when(F.col("piece") < F.col("full"), largest).otherwise(F.col("size") % largest).cast("int"),
    ).filter((F.col("length") > 0) | (F.col("size") == 0)).withColumn("start", F.col("piece").cast("long") * largest)
    filling = pieces.filter((F.col("length") == largest) | (F.col("length") == 0)).select(
        "key", "piece", "start", "length",
        F.when(F.col("length") > 0, F.concat_ws("-", F.lit("f"), "row", "piece")).alias("sequence"),
        F.when(F.col("length") > 0, 0).alias("offset"), F.when(F.col("length") > 0, largest).alias("capacity"))
    schema = pieces.select("key", "piece", "start", "length", F.lit("").alias("sequence"), F.lit(0).alias("offset"), F.lit(0).alias("capacity")).schema

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        place, offset, capacity = best_pack(frame["length"].to_numpy(), lengths)
        group = int(frame["group"].iat[0])
        return frame[["key", "piece", "start", "length"]].assign(
            sequence=[f"{group}-{p}" for p in place], offset=offset.astype("int32"), capacity=capacity.astype("int32"))

    rests = pieces.filter((F.col("length") < largest) & (F.col("length") > 0)).select("key", "row", "piece", "start", "length", "group")
    done = rests.groupBy("group").applyInPandas(packed, schema)
    return done.unionByName(filling).withColumnRenamed("key", key)
