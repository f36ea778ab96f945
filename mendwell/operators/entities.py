"""Entity resolution without labels: rows that mean the same thing, as groups.

Fields are normalised and weighed. Two rows are linked if the weights of the fields in
which they agree reach a score, and an entity is what hangs together by links. No pairs are formed: the
smallest sets of fields that reach the score are blocking keys, and whatever shares one of
them is linked already, so a block is tied to its least member.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.operators.groups import with_group_stats
from mendwell.session import cut_lineage


@dataclass(frozen=True)
class Evidence:
    """A field, what agreeing in it counts, and spellings that mean another one (both normalised)."""

    column: str
    weight: int = 1
    aliases: Mapping[str, str] = field(default_factory=dict)


def normalised(value: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Without case, zero-width signs and surplus blanks; an alias as what it stands for; empty text is no value."""
    text = F.regexp_replace(value.cast("string"), "[\\u200B-\\u200D\\u2060\\uFEFF]", "")
    text = F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))
    if aliases:
        pairs = [F.lit(word) for pair in aliases.items() for word in pair]
        text = F.coalesce(F.try_element_at(F.create_map(*pairs), text), text)
    return F.nullif(text, F.lit(""))


def least_sets(weights: Sequence[int], score: int) -> list[tuple[int, ...]]:
    """The smallest sets of fields whose weights reach the score."""
    found: list[tuple[int, ...]] = []
    for size in range(1, len(weights) + 1):
        for some in combinations(range(len(weights)), size):
            if sum(weights[i] for i in some) >= score and not any(set(less) <= set(some) for less in found):
                found.append(some)
    return found


def _toward_least(edges: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for all nodes of the edges ``u``, ``v`` (numbers).

    In each turn a node is tied to the least neighbour of its least neighbour, and every edge is moved to the
    least neighbours of its ends; ways to the root halve, so turns grow with the logarithm of the longest one. When
    nothing changes, all ends of edges know the same root. A turn is sums by node and joins on nodes.
    """
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        least = cut_lineage(_toward_least(edges))
        low = least.select(F.col("u").alias("v"), F.col("least").alias("far"))
        jumps = least.withColumnRenamed("least", "v").join(low, "v")
        moved = edges.join(least, "u").join(low, "v").select(F.col("least").alias("u"), F.col("far").alias("v"))
        after = moved.unionByName(jumps.select("u", F.col("far").alias("v"))).unionByName(jumps.select(F.col("v").alias("u"), F.col("far").alias("v")))
        after = after.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        after = cut_lineage(after)
        same = [df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for df in (edges, after)]
        edges = after
        if same[0] == same[1]:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def resolve(df: DataFrame, keys: Sequence[str], evidence: Sequence[Evidence], score: int) -> DataFrame:
    """Rows of entities that have several: the keys, ``entity`` (the least key of it, as a struct) and ``rows_alike``.

    A NULL agrees with nothing. Rows that agree in all fields are one from the start, so a
    group of copies, however large, takes one place in its blocks.
    """
    weights = [item.weight for item in evidence]
    names = [f"_f{no}" for no in range(len(evidence))]
    values = [normalised(F.col(item.column), item.aliases) for item in evidence]
    known = reduce(lambda a, b: a + b, [F.when(F.col(name).isNotNull(), weight).otherwise(0) for name, weight in zip(names, weights)])
    rows = df.select(*keys, *[
        F.when(value.isNotNull(), F.struct(F.xxhash64(F.lit(1), value).alias("a"), F.xxhash64(F.lit(2), value).alias("b"))).alias(name)
        for value, name in zip(values, names)
    ]).filter(known >= score)  # others reach no score with anything
    rows = cut_lineage(rows.withColumn("_all", F.sha2(F.to_json(F.struct(*names)), 256)))
    reps = cut_lineage(rows.groupBy("_all").agg(
        F.min(F.struct(*keys)).alias("least"), F.count("*").alias("n"), *[F.first(name).alias(name) for name in names]
    ).withColumn("id", F.monotonically_increasing_id()))
    blocks = []
    for no, some in enumerate(least_sets(weights, score)):
        there = reduce(lambda a, b: a & b, [F.col(names[i]).isNotNull() for i in some])
        blocks.append(F.when(there, F.struct(F.lit(no).alias("set"), F.xxhash64(F.lit(1), *[names[i] for i in some]).alias("a"),
                                             F.xxhash64(F.lit(2), *[names[i] for i in some]).alias("b"))))
    members = reps.select("id", F.explode(F.array_compact(F.array(*blocks))).alias("block"))
    heads = members.groupBy("block").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    roots = connected(members.join(heads, "block").select(F.col("id").alias("u"), F.col("head").alias("v")))
    placed = reps.join(roots, reps["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    placed = cut_lineage(placed.select("_all", "least", "n", "root"))
    whole = placed.groupBy("root").agg(F.min("least").alias("entity"), F.sum("n").alias("rows_alike")).filter("rows_alike > 1")
    stats = placed.join(whole, "root", "left").select("_all", "n", "entity", "rows_alike")
    found = with_group_stats(rows.select(*keys, "_all"), stats, ["_all"], ["entity", "rows_alike"])
    return found.filter(F.col("entity").isNotNull()).select(*keys, "entity", "rows_alike")
