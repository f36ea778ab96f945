"""The trie of all conversation prefixes, from range minima over sorted common prefixes.

Conversations are sorted as sequences of turns, and each is compared with the one before it: the number
of first turns that both share is its LCP. The members of a prefix of d turns then stand side by side; they
reach to the left and to the right as far as no LCP is below d. Sparse tables of minima
over ranges of 1, 2, 4 … LCPs let each candidate prefix search for both ends by itself, by binary steps,
without a stack or any order among the candidates. What a node reports comes from prefix sums
over its interval, and from a sparse table of least ids.

Sorted conversations lie in range partitions, so that a frequent first turn or a conversation repeated very
often is spread over many of them. A task searches its own partition. A search that reaches the edge goes on in a
sparse table over the partitions, and ends in the falling minima seen from the edge of the last
one. That summary of the partitions is all that goes through the driver: a row for each, as long as its
first and last conversation are deep.

A turn is a 128-bit name in the sort; its text moves nowhere. One conversation is one row of 16 bytes a turn, and
the digest of the ids that end in one node is a stream, in blocks of ids.

Null roles and texts become empty; turns with one number are ordered by their names; repeated rows are
turns of their own. Rows without a ``conv_id`` belong to no conversation. An empty table gives an
empty result, and other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwell.llm.conversations import named_turns
from mendwell.session import cut_lineage

NAME_BYTES = 16
PART_ROWS = 200_000
PART_BYTES = 32 << 20
CHUNK = 200_000
IDS = 1024
BIG = 1 << 31

NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
         " saved_tokens long, ends_sha256 string")
_LOCAL = {
    "part": "int", "kind": "int", "depth": "long", "n": "long", "total": "long", "fresh": "long", "leaves": "long", "least": "long",
    "children": "long", "before": "long", "own": "long", "parent": "long", "right": "boolean", "parent_right": "boolean",
    "parent_left": "boolean", "first": "boolean", "ends": "string", "place": "long", "body": "string",
}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_NODE, _SUMMARY, _IDS = 0, 1, 2
EMPTY = hashlib.sha256(b"").hexdigest()


# --- conversations as sequences ---------------------------------------------------------------------------------------

def own_turns(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, its ordered turns as structs of ``name`` and ``size`` (code points)."""
    named = named_turns(turns).filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", "name", F.char_length("text").alias("size"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "name", "size")))
    return named.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["name"], t["size"])).alias("turns"))


def shared_heads(conv: Column) -> tuple[Column, Column]:
    """The conversation whose first turns ``conv`` takes over, and how many."""
    return conv - conv % 100, (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(own: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Each conversation with the head of another one in place of its own first turns; see ``shared_heads``."""
    base, taken = shared_heads(F.col("conv_id"))
    heads = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    joined = own.withColumns({"base": base, "taken": taken}).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("taken")), none),
        F.coalesce(F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns") - F.col("taken"), F.lit(0))), none),
    ).alias("turns"))


# --- one partition ----------------------------------------------------------------------------------------------------

def sparse(values: np.ndarray) -> list[np.ndarray]:
    """Minima of ``values`` over all ranges of 1, 2, 4 … places, by their first place."""
    table, width = [values], 1
    while 2 * width <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    return table


def reach(table: list[np.ndarray], start: np.ndarray, depth: np.ndarray, way: int) -> np.ndarray:
    """How far one gets from ``start``, to the right (1) over values after it or to the left (-1) over its own and those before
    it, with all values at least ``depth``; place 0 is never passed to the left."""
    at, last = start.copy(), len(table[0]) - 1
    for k in range(len(table) - 1, -1, -1):
        width = 1 << k
        fits = at + width <= last if way > 0 else at - width >= 0
        first = np.where(fits, at + 1 if way > 0 else at - width + 1, 0)
        at += np.where(fits & (table[k][first] >= depth), way * width, 0)
    return at


def least(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum over ``first`` to ``last``; a very large number where that is empty."""
    width = last - first + 1
    full = width > 0
    k = np.where(full, np.frexp(np.maximum(width, 1).astype(float))[1] - 1, 0)
    out = np.full(len(first), np.iinfo(np.int64).max)
    for level in np.unique(k[full]):
        hit = full & (k == level)
        out[hit] = np.minimum(table[level][first[hit]], table[level][last[hit] - (1 << int(level)) + 1])
    return out


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place in it of each element."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def common(names: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """LCP of each row and the one before it; 0 for the first."""
    most = np.minimum(length, np.concatenate([[0], length[:-1]]))
    row, k = _ragged(most)
    other = np.any(names[start[row] + k] != names[start[row - 1] + k], axis=1)
    np.minimum.at(most, row[other], k[other])
    return most


def _falling(values: np.ndarray) -> np.ndarray:
    """Places where a value is below all before it."""
    low = np.minimum.accumulate(values)
    return np.flatnonzero(np.concatenate([[True], values[1:] < low[:-1]])) if len(values) else np.zeros(0, np.int64)


def _cum(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


class Part:
    """One range partition of the sorted conversations."""

    def __init__(self, conv: np.ndarray, names: np.ndarray, length: np.ndarray, sizes: np.ndarray):
        self.conv, self.length, self.names = conv, length, names
        self.start = np.cumsum(length) - length
        self.sums = _cum(sizes)
        self.total = self.before(np.arange(len(conv)), length)
        self.lcp = common(names, self.start, length)
        rows = np.arange(len(conv))
        self.fresh = np.where(rows > 0, self.total - self.before(rows, self.lcp), 0)
        self.leaf = np.append(self.lcp[1:] < length[:-1], False)  # that of the last row is known later
        self.table, self.ids = sparse(self.lcp), sparse(conv)
        self.totals, self.freshes, self.leaves = _cum(self.total), _cum(self.fresh), _cum(self.leaf)
        self.forking = length > self.lcp  # else it only repeats the one before
        self.forks = np.sort((self.lcp * len(conv) + rows)[1:][self.forking[1:]])  # by LCP, then by place
        same = (self.lcp == length) & (np.concatenate([[-1], length[:-1]]) == length)
        same[0] = False
        self.run = np.flatnonzero(~same)  # first rows of equal conversations
        self.run_end = np.append(self.run[1:], len(conv))

    def before(self, row: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Code points in so many first turns."""
        return self.sums[self.start[row] + turns] - self.sums[self.start[row]]

    def joined(self, first: int, last: int) -> str:
        return ",".join(map(str, self.conv[first:last].tolist()))

    def nodes(self, row: np.ndarray, depth: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        n, last = len(self.conv), len(self.conv) - 1
        up = np.maximum(depth - 1, 0)
        right, left = reach(self.table, row, depth, 1), row
        parent_right, parent_left = reach(self.table, row, up, 1), reach(self.table, row, up, -1)
        forks = np.searchsorted(self.forks, depth * n + right, "right") - np.searchsorted(self.forks, depth * n + row, "right")
        return {
            "depth": depth, "n": right - left + 1, "total": self.totals[right + 1] - self.totals[left],
            "fresh": self.freshes[right + 1] - self.freshes[left + 1], "leaves": self.leaves[right + 1] - self.leaves[left],
            "least": least(self.ids, left, right), "children": forks + (self.length[row] > depth),
            "before": self.before(row, up), "own": self.total[row], "parent": least(self.ids, parent_left, parent_right),
            "right": right == last, "parent_right": parent_right == last, "parent_left": parent_left == 0, "first": row == 0,
            "ends": np.where(self.length[row] > depth, EMPTY, ends[row]),
        }

    def summary(self) -> str:
        lcp, n = self.lcp[1:], len(self.conv)
        down, up = _falling(lcp) + 1, n - 1 - _falling(lcp[::-1])
        until = np.append(down[1:], n)
        lows, highs = np.minimum.accumulate(self.conv), np.minimum.accumulate(self.conv[::-1])[::-1]
        first, last = (self.names[self.start[k]:self.start[k] + self.length[k]].tobytes().hex() for k in (0, n - 1))
        return json.dumps({
            "n": n, "total": int(self.totals[-1]), "fresh": int(self.freshes[-1]), "leaves": int(self.leaves[-1]),
            "least": int(self.conv.min()), "inner": int(lcp.min()) if n > 1 else BIG - 1, "first": first, "last": last,
            "sizes": np.diff(self.sums[:self.length[0] + 1]).tolist(), "one_run": len(self.run) == 1,
            "down": [[int(self.lcp[p]), int(p), int(self.totals[p]), int(self.freshes[p]), int(self.leaves[p]), int(lows[p - 1]),
                      int(np.count_nonzero((self.lcp == self.lcp[p])[p:q] & self.forking[p:q]))] for p, q in zip(down, until)],
            "up": [[int(self.lcp[p]), int(highs[p])] for p in up],
        })


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[int, Part] | None:
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return None
    rows = pa.Table.from_batches(held)
    paths = rows["path"].to_pylist()
    length = np.fromiter(map(len, paths), np.int64, len(paths)) // NAME_BYTES
    names = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    sizes = rows["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return rows["part"][0].as_py(), Part(rows["conv_id"].to_numpy().astype(np.int64), names, length, sizes)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that begin in a partition, as far as it shows; its summary; ids of its first and last conversation."""
    found = _read(batches)
    if found is None:
        return
    number, part = found

    def rows(kind: int, **values) -> pa.RecordBatch:
        size = len(next(iter(values.values())))
        values |= {"part": np.full(size, number), "kind": np.full(size, kind)}
        return pa.RecordBatch.from_arrays([
            pa.array(values[name], _ARROW[of]) if name in values else pa.nulls(size, _ARROW[of]) for name, of in _LOCAL.items()
        ], names=list(_LOCAL))

    ends = np.full(len(part.conv), None, dtype=object)
    for first, last in zip(part.run[:-1].tolist(), part.run_end.tolist()):  # the last one may go on
        ends[first] = hashlib.sha256(part.joined(first, last).encode()).hexdigest()
    lowest = part.lcp.copy()
    lowest[0] = -1
    counts = part.length - lowest
    edges = np.searchsorted(_cum(counts), np.arange(0, int(counts.sum()) + CHUNK, CHUNK), "left")
    edges = np.unique(np.clip(edges, 0, len(counts)))
    for first, last in zip(edges[:-1], edges[1:]):
        row, k = _ragged(counts[first:last])
        if len(row):
            yield rows(_NODE, **part.nodes(row + first, k + lowest[row + first] + 1, ends))
    yield rows(_SUMMARY, body=[part.summary()])
    for place, head in ((0, True), (-1, False))[:min(len(part.run), 2)]:
        first, last = int(part.run[place]), int(part.run_end[place])
        for start in range(first, last, IDS):
            yield rows(_IDS, first=[head], place=[start], body=[part.joined(start, min(start + IDS, last))])


# --- all partitions ---------------------------------------------------------------------------------------------------

class Parts:
    """The partitions in their order, each as one place."""

    def __init__(self, numbers: list[int], summaries: list[dict]):
        self.numbers = np.array(numbers)
        get = lambda name: np.array([s[name] for s in summaries], np.int64)
        first, last = ([np.frombuffer(bytes.fromhex(s[k]), np.uint64).reshape(-1, 2) for s in summaries] for k in ("first", "last"))
        edge = [-1]  # LCP over the edge to the partition before
        for one, two in zip(last, first[1:]):
            most = min(len(one), len(two))
            other = np.flatnonzero(np.any(one[:most] != two[:most], axis=1))
            edge.append(int(other[0]) if len(other) else most)
        self.edge, self.inner, self.least_id = np.array(edge), get("inner"), get("least")
        self.low = np.minimum(self.edge, self.inner)
        over = np.append(self.edge[1:], -1)
        self.last_leaf = (over < [len(path) for path in last]).astype(np.int64)
        self.first_fresh = np.array([sum(s["sizes"][max(e, 0):]) for s, e in zip(summaries, edge)], np.int64)
        self.cums = [_cum(x) for x in (get("n"), get("total"), get("fresh") + self.first_fresh, get("leaves") + self.last_leaf)]
        self.table, self.ids = sparse(self.low), sparse(self.least_id)
        down = [(p, *record) for p, s in enumerate(summaries) for record in s["down"]]
        up = [(p, *record) for p, s in enumerate(summaries) for record in s["up"]]
        self.down = np.array(down or np.zeros((0, 8)), np.int64).T
        self.up = np.array(up or np.zeros((0, 3)), np.int64).T
        self.down_keys, self.up_keys = (r[0] * BIG + (BIG - 1 - r[1]) for r in (self.down, self.up))
        forking = [int(len(path) > e) for path, e in zip(first, edge)]
        counted = [(e, p, f) for p, (e, f) in enumerate(zip(edge, forking))] + [
            (s["down"][-1][0], p, s["down"][-1][6]) for p, s in enumerate(summaries) if s["down"]]
        counted = np.array(sorted(counted), np.int64).T
        self.value_keys, self.value_sums = counted[0] * (len(edge) + 1) + counted[1], _cum(counted[2])
        self.forking = np.array(forking)
        self.one_run = [s["one_run"] for s in summaries]
        # which partition holds the beginning of its first and of its last run of equal conversations
        self.first_owner, self.last_owner = [], []
        for p, s in enumerate(summaries):
            goes_on = p > 0 and edge[p] == len(last[p - 1]) == len(first[p])
            self.first_owner.append(self.last_owner[-1] if goes_on else p)
            self.last_owner.append(self.first_owner[-1] if s["one_run"] else p)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.numbers, numbers)

    def _record(self, keys: np.ndarray, part: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first falling minimum of the part that is below the depth."""
        return np.searchsorted(keys, part * BIG + (BIG - 1 - depth), "right")

    def to_right(self, part: np.ndarray, depth: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """What follows the part with LCPs of at least ``depth``: rows, totals, fresh code points and leaves; the least id; forks."""
        last = reach(self.table, part, depth, 1)
        sums = [cum[last + 1] - cum[part + 1] for cum in self.cums]
        low = least(self.ids, part + 1, last)
        values = len(self.numbers) + 1
        forks = self.value_sums[np.searchsorted(self.value_keys, depth * values + last, "right")] - self.value_sums[
            np.searchsorted(self.value_keys, depth * values + part, "right")]
        into = np.minimum(last + 1, len(self.numbers) - 1)
        hit = np.flatnonzero((last + 1 < len(self.numbers)) & (self.edge[into] >= depth))
        into, depth = into[hit], depth[hit]
        record = self._record(self.down_keys, into, depth)
        for k, extra in enumerate((self.down[2], self.down[3], self.down[4], self.down[5])):
            sums[k][hit] += extra[record] + (self.first_fresh[into] if k == 2 else 0)
        low[hit] = np.minimum(low[hit], self.down[6][record])
        earlier = np.maximum(record - 1, 0)
        equal = (record > 0) & (self.down[0][earlier] == into) & (self.down[1][earlier] == depth)
        forks[hit] += (self.edge[into] == depth) * self.forking[into] + np.where(equal, self.down[7][earlier], 0)
        return sums, low, forks

    def to_left(self, part: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Least id of what stands before the part with LCPs of at least ``depth``; its own edge is not below it."""
        at = reach(self.table, part - 1, depth, -1)  # the nearest with an LCP below the depth
        record = self._record(self.up_keys, at, depth)
        found = self.least_id[at]
        hit = self.inner[at] < depth
        found[hit] = self.up[2][record[hit]]
        return np.minimum(found, least(self.ids, at + 1, part - 1))


def _finished(parts: Parts, ends: dict[int, str], rows: pa.RecordBatch) -> pa.RecordBatch:
    """Nodes whose searches have gone on over the edges of their partitions."""
    part = parts.places(rows["part"].to_numpy())
    depth = rows["depth"].to_numpy()
    keep = np.flatnonzero(~rows["first"].to_numpy(zero_copy_only=False) | (depth > parts.edge[part]))
    rows, part, depth = rows.take(pa.array(keep)), part[keep], depth[keep]
    number = {name: rows[name].to_numpy(zero_copy_only=False).copy() for name in _LOCAL if name not in ("ends", "body", "place")}
    on = np.flatnonzero(number["right"])
    sums, low, forks = parts.to_right(part[on], depth[on])
    for name, more in zip(("n", "total", "fresh", "leaves"), sums):
        number[name][on] += more
    number["leaves"][on] += parts.last_leaf[part[on]]
    number["least"][on] = np.minimum(number["least"][on], low)
    number["children"][on] += forks
    up = np.maximum(depth - 1, 0)
    on = np.flatnonzero(number["parent_right"])
    _, low, _ = parts.to_right(part[on], up[on])
    number["parent"][on] = np.minimum(number["parent"][on], low)
    on = np.flatnonzero(number["parent_left"] & (parts.edge[part] >= up))
    number["parent"][on] = np.minimum(number["parent"][on], parts.to_left(part[on], up[on]))
    # every member repeats its turns from this depth on, and every node below has its own text once
    saved = number["total"] - number["n"] * number["before"] - (number["fresh"] + number["own"] - number["before"])
    closed = [ends[p] if e is None else e for p, e in zip(part.tolist(), rows["ends"].to_pylist())]
    return pa.RecordBatch.from_arrays([
        pa.array(number["least"]), pa.array(depth), pa.array(number["parent"], mask=depth == 0), pa.array(number["n"]),
        pa.array(number["children"]), pa.array(number["leaves"]), pa.array(saved), pa.array(closed, pa.string()),
    ], names=[field.split()[0] for field in NODES.split(", ")])


def _open_ends(made: DataFrame, parts: Parts) -> dict[int, str]:
    """Digests of the ids of conversations that are the last of their partition, by the place of the partition they begin in."""

    def owned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = parts.places(batch["part"].to_numpy())
            head = batch["first"].to_numpy(dtype=bool)
            owner = np.where(head, np.array(parts.first_owner)[at], np.array(parts.last_owner)[at])
            closed = head & (owner == at) & (np.array(parts.last_owner)[at] != at)
            closed |= head & (owner == at) & ~np.array(parts.one_run)[at]
            yield pd.DataFrame({"owner": owner, "at": at, "place": batch["place"], "body": batch["body"]})[~closed]

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, state = None, hashlib.sha256()
        for batch in batches:
            for own, body in zip(batch["owner"].tolist(), batch["body"].tolist()):
                if own != owner:
                    if owner is not None:
                        yield pd.DataFrame({"owner": [owner], "ends": [state.hexdigest()]})
                    owner, state = own, hashlib.sha256(body.encode())
                else:
                    state.update(b"," + body.encode())
        if owner is not None:
            yield pd.DataFrame({"owner": [owner], "ends": [state.hexdigest()]})

    blocks = made.filter(F.col("kind") == _IDS).select("part", "first", "place", "body").mapInPandas(
        owned, "owner long, at long, place long, body string")
    streams = blocks.repartition("owner").sortWithinPartitions("owner", "at", "place").mapInPandas(digests, "owner long, ends string")
    return {row["owner"]: row["ends"] for row in streams.collect()}  # at most one a partition


def nodes(sequences: DataFrame, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """All nodes of the trie of ``sequences`` (``conv_id``, unique, and ``turns``); columns as in ``report``."""
    spark = sequences.sparkSession
    paths = cut_lineage(sequences.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes")))
    rows, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.length("path")), F.lit(0))).first()
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // part_rows), -(-size // part_bytes))
    placed = paths.repartitionByRange(count, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    schema = ", ".join(f"`{name}` {of}" for name, of in _LOCAL.items())
    made = cut_lineage(placed.select(F.spark_partition_id().alias("part"), "conv_id", "path", "sizes").mapInArrow(_local, schema))
    found = made.filter(F.col("kind") == _SUMMARY).select("part", "body").orderBy("part").collect()  # a row a partition
    if not found:
        return spark.createDataFrame([], NODES)
    parts = Parts([row["part"] for row in found], [json.loads(row["body"]) for row in found])
    known = spark.sparkContext.broadcast((parts, _open_ends(made, parts)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _finished(*known.value, batch)

    return made.filter(F.col("kind") == _NODE).mapInArrow(finish, NODES)


def report(turns: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    return nodes(rebuilt(cut_lineage(own_turns(turns))))
