"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cells of ``width`` in which its projections on random
Gaussian directions fall. A query visits the buckets around its own in the order of
their estimated success: a neighbour at distance r moves a projection by a normal
variable of deviation r, which gives each cell a chance; the buckets with the best
products of chances are taken, best first, until they sum to the chance wanted
of a table. Distances of what lies in them are computed exactly in double precision, and the
tables' finds are merged.

Number of directions, width and r come from a bounded sample (``SAMPLE`` vectors); all vectors are
indexed. Buckets and the queries at a bucket are cut into blocks that a task can hold, so a
hot bucket is spread. A query that finds fewer than it wants looks everywhere, in the
same blocks.

Vectors that are null, zero or hold nulls or what is not finite take no part, nor do null ids; rows
with one id count as its nearest one and are dealt to blocks one by one; vectors of other lengths are no candidates. An empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendwell.session import cut_lineage

NEAREST = 10
TABLES = 2
CHANCE = 0.98  # that some table holds a neighbour at the distance r
SAMPLE = 4096
OCCUPANCY = 1024
MOST_DIRECTIONS, PROBES = 12, 256
INDEX_BLOCK, QUERY_BLOCK = 2048, 256
SEED = 5


@dataclass(frozen=True)
class Plan:
    directions: int
    width: float
    reach: float
    tables: int
    chance: float  # of one table

    def lines(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.RandomState([SEED, size])
        count = self.tables * self.directions
        return draw.normal(size=(count, size)), draw.uniform(0, self.width, size=count)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Place of each vector on each line of each table, in cells."""
        directions, shifts = self.lines(vectors.shape[1])
        found = (vectors @ directions.T + shifts) / self.width
        return found.reshape(len(vectors), self.tables, self.directions)


def _name(cells: np.ndarray) -> np.ndarray:
    total = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        total = (total ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return total.view(np.int64)


def _normal(x: float) -> float:
    return 0.5 * (1 + erf(x / sqrt(2)))


def probes(place: np.ndarray, reach: float, chance: float, most: int | None = None) -> list[tuple[int, ...]]:
    """Buckets around ``place`` (in cells, as ``reach``), best first, until their chances reach ``chance``."""
    lists = []
    for x in place.tolist():
        low, high = int(np.floor(x - 4 * reach - 1)), int(np.floor(x + 4 * reach + 1))
        chances = [(_normal((c + 1 - x) / reach) - _normal((c - x) / reach), c) for c in range(low, high + 1)]
        lists.append(sorted((p for p in chances if p[0] > 1e-12), reverse=True))
    if not lists:
        return [()]
    first = (0,) * len(lists)

    def worth(at: tuple[int, ...]) -> float:
        product = 1.0
        for options, i in zip(lists, at):
            product *= options[i][0]
        return product

    heap, total, found = [(-worth(first), first)], 0.0, []
    while heap and total < chance and (most is None or len(found) < most):
        value, at = heapq.heappop(heap)
        total -= value
        found.append(tuple(options[i][1] for options, i in zip(lists, at)))
        last = max((k for k, i in enumerate(at) if i), default=0)
        for k in range(last, len(lists)):  # each bucket is reached by one way
            if at[k] + 1 < len(lists[k]):
                step = (*at[:k], at[k] + 1, *at[k + 1:])
                heapq.heappush(heap, (-worth(step), step))
    return found


def usable(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector)
    inf = F.lit(float("inf"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return table.filter(F.col(key).isNotNull() & v.isNotNull() & good & F.exists(v, lambda x: x != 0)).select(
        F.col(key).cast("long").alias("id"), v.alias("vector"))


def plan_for(vectors: DataFrame, count: int, nearest: int = NEAREST) -> Plan:
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sizes = [len(r["vector"]) for r in rows]
    size = max(set(sizes), key=sizes.count)
    sample = np.array([r["vector"] for r in rows if len(r["vector"]) == size], dtype=np.float64)
    chance = 1 - (1 - CHANCE) ** (1 / TABLES)
    spread = sqrt(sample.var(axis=0).sum())
    if len(sample) < 2 or not spread:
        return Plan(0, 1.0, 1.0, 1, 1.0)
    asked = sample[:128]
    apart = np.sqrt(np.maximum((asked**2).sum(1)[:, None] + (sample**2).sum(1)[None, :] - 2 * asked @ sample.T, 0))
    nth = min(max(1, round(nearest * len(sample) / count)), len(sample) - 1)
    reach = float(np.quantile(np.sort(apart, axis=1)[:, nth], 0.9))
    width = spread
    reach = max(reach, spread * 1e-3)
    best = Plan(1, width, reach, TABLES, chance)
    for directions in range(2, min(MOST_DIRECTIONS, max(1, round(log(max(count / OCCUPANCY, 1)) / log(3)))) + 1):
        plan = Plan(directions, width, reach, TABLES, chance)
        places = plan.places(asked[:16])
        visited = np.mean([len(probes(p[0], reach / width, chance, 4 * PROBES)) for p in places])
        if visited > PROBES:
            break
        best = plan
    return best


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _by_size(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    yield from frame.groupby(frame["vector"].map(len), sort=True)


def _index(plan: Plan):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, frame in _by_size(batch):
                names = _name(np.floor(plan.places(_matrix(frame["vector"]))))
                for table in range(plan.tables):
                    yield pd.DataFrame({
                        "table": table, "size": size, "bucket": names[:, table], "id": frame["id"].to_numpy(),
                        "vector": frame["vector"].to_numpy()})
    return index


def _ask(plan: Plan):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, frame in _by_size(batch):
                places = plan.places(_matrix(frame["vector"]))
                for at, (key, vector) in enumerate(zip(frame["id"], frame["vector"])):
                    for table in range(plan.tables):
                        cells = np.array(probes(places[at, table], plan.reach / plan.width, plan.chance), dtype=np.float64)
                        names = _name(cells.reshape(len(cells), plan.directions))
                        yield pd.DataFrame({"table": table, "size": size, "bucket": names, "id": key, "vector": [vector] * len(names)})
    return ask


def _nearest(nearest: int):
    def near(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The nearest ids of a block of the index for each query of a block."""
        if index.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        index = index.sort_values("id", kind="stable")
        ids, x, q = index["id"].to_numpy(), _matrix(index["vector"]), _matrix(asked["vector"])
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        found = []
        squares = (x**2).sum(1)
        rough = (q**2).sum(1)[:, None] + squares[None, :] - 2 * q @ x.T
        slack = 1e-9 * (squares.max() + (q**2).sum(1))
        for at, key in enumerate(asked["id"]):
            near = rough[at].copy()
            near[ids == key] = np.inf
            least = np.minimum.reduceat(near, starts)  # of each id
            if len(least) > nearest:
                close = np.flatnonzero(near <= np.partition(least, nearest - 1)[nearest - 1] + slack[at])
            else:
                close = np.arange(len(near))
            close = close[ids[close] != key]
            exact = np.sqrt(((x[close] - q[at]) ** 2).sum(1))
            order = np.lexsort((ids[close], exact))
            order = order[np.sort(np.unique(ids[close][order], return_index=True)[1])][:nearest]
            found.append(pd.DataFrame({"query_id": key, "vec_id": ids[close[order]], "score": exact[order]}))
        return pd.concat(found)
    return near


def _search(vectors: DataFrame, queries: DataFrame, plan: Plan, nearest: int) -> DataFrame:
    kind = vectors.schema["vector"].dataType.simpleString()
    schema = f"table int, size int, bucket long, id long, vector {kind}"
    row = F.monotonically_increasing_id()  # blocks are dealt by it, as an id may repeat
    index = cut_lineage(vectors.mapInPandas(_index(plan), schema).withColumn("row", row))
    asked = cut_lineage(queries.mapInPandas(_ask(plan), schema).withColumn("row", row))
    where = ["table", "size", "bucket"]
    blocks = index.groupBy(where).agg(F.ceil(F.count(F.lit(1)) / INDEX_BLOCK).cast("int").alias("parts")).join(
        asked.groupBy(where).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("turns")), where)
    blocks = cut_lineage(blocks)
    index = index.join(blocks, where).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    asked = asked.join(blocks, where).withColumn("turn", F.pmod(F.xxhash64("row"), "turns").cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys, columns = [*where, "part", "turn"], [*where, "part", "turn", "id", "vector"]
    near = index.select(columns).groupBy(keys).cogroup(asked.select(columns).groupBy(keys)).applyInPandas(
        _nearest(nearest), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return cut_lineage(near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= nearest))


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, plan: Plan | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for frames of ``id`` and ``vector``; see ``usable``."""
    count = vectors.count()
    plan = plan or (plan_for(vectors, count, nearest) if count else Plan(0, 1.0, 1.0, 1, 1.0))
    found = _search(vectors, queries, plan, nearest)
    if plan.directions:
        enough = found.groupBy("query_id").count().filter(F.col("count") >= nearest)
        short = cut_lineage(queries.join(enough, queries["id"] == enough["query_id"], "left_anti"))
        if not short.isEmpty():
            rest = _search(vectors, short, Plan(0, 1.0, 1.0, 1, 1.0), nearest)
            found = found.join(short, found["query_id"] == short["id"], "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")


def report(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, nearest: int = NEAREST) -> DataFrame:
    """The nearest of each row whose id is divisible by ``every``."""
    vectors = cut_lineage(usable(table, key, vector))
    return search(vectors, vectors.filter(F.col("id") % every == 0), nearest)
