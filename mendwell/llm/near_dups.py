"""Near duplicates: an n-gram Jaccard join by a MinHash LSH forest.

A text is the set of its runs of five words (lower case, split at white space; a shorter
text is one run). Copies are joined first, so that what follows sees each text once. Every
text has a key in each of ``TREES`` trees: ``LABEL`` minima of 16 bits, one after the other. The keys of a tree are a
prefix trie, and texts under one node of it, sorted side by side by the shuffle, are a bucket. The matched prefix begins at
the whole key and is shortened by one minimum at a time, in all trees: each time only pairs that meet for the
first time are compared, exactly, by their sets; texts that the last length leaves alone in every tree are set aside before. Their similarities tell how probably such a pair is met at this length, and so how
many there are in all; shortening ends when the share found reaches the wanted recall, at the latest at the length
that has this recall for pairs just at the threshold (``depth``). A large bucket is cut into blocks, and pairs
of blocks are worked on apart. A pair counts in the first tree that brings it together.

No pair leaves a task: only sums of links, and edges that hold together what is
linked within a task. So a group of m copies makes m rows, whatever its links.

Null texts count as empty; texts without words are linked to their copies alone. Null keys are last in
a class; repeated rows are copies; texts are read whole, however long. An empty table gives an empty result, and
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mendwell.llm.components import components
from mendwell.session import cut_lineage, meet

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.995
TREES, LABEL = 16, 8
BLOCK_ROWS, BLOCK_BYTES = 512, 16 << 20
FEW = 24  # up to so many texts are compared pair by pair, more by a matrix product
_CHUNK = 2048
_MEMORY = 500_000


def depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, label: int = LABEL) -> int:
    """Longest prefix with which the forest has the recall for pairs at the threshold: none shorter is ever asked for."""
    length = label
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hash of each run of ``words`` words."""
    parts = (text or "").lower().split()
    hashed = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(hashed))
    if not width:
        return hashed
    total = np.zeros(len(hashed) - width + 1, np.uint64)
    for i in range(width):
        total = _mixed(total + hashed[i:len(hashed) - width + 1 + i])
    return total


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(20_011)
    whole = draw.randint(0, 1 << 32, size=(4, count), dtype=np.uint64)
    return (whole[0] << np.uint64(32)) | whole[1] | np.uint64(1), (whole[2] << np.uint64(32)) | whole[3]


def signature(text: str | None, label: int = LABEL, trees: int = TREES) -> bytes | None:
    """The keys of all trees, one after the other; None for a text without words."""
    runs = shingles(text)
    if not len(runs):
        return None
    times, plus = _functions(trees * label)
    least = np.full(trees * label, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(runs), _CHUNK):
        values = np.multiply.outer(times, runs[start:start + _CHUNK])
        values += plus[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (_mixed(least) >> np.uint64(40)).astype(">u2").tobytes()


def prefixes(keys: list[bytes], level: int, label: int = LABEL) -> np.ndarray:
    """A number for the first ``level`` minima of each text in each tree."""
    minima = np.frombuffer(b"".join(keys), ">u2").reshape(len(keys), -1, label).astype(np.uint64)
    total = np.zeros(minima.shape[:2], np.uint64)
    for place in range(level):
        total = _mixed(total + minima[:, :, place] + np.uint64(1))
    return total


def met(similarity: np.ndarray | float, level: int, trees: int = TREES) -> np.ndarray | float:
    """How probably a pair shares its first ``level`` minima in a tree."""
    return 1 - (1 - similarity**level) ** trees


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of one whole group each, from batches sorted by ``keys``."""
    rest = None
    for batch in batches:
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(frame):
            continue
        ids = frame[keys].to_numpy(dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        for start, end in zip(starts[:-1], starts[1:]):
            yield frame.iloc[start:end]
        rest = frame.iloc[starts[-1]:]
    if rest is not None:
        yield rest


def _first_met(group: pd.DataFrame, level: int) -> np.ndarray:
    """Which pairs of the group meet here: i < j, of the right blocks, in no earlier tree and with no longer prefix."""
    keys = group["trees"].tolist()
    now = prefixes(keys, level)
    tree, low, high = (int(group[c].iat[0]) for c in ("tree", "low", "high"))
    block = group["block"].to_numpy()
    count = len(group)
    pairs = np.triu(np.ones((count, count), bool), 1)
    if low != high:
        pairs &= block[:, None] != block[None, :]
    pairs &= now[:, tree][:, None] == now[:, tree][None, :]
    for earlier in range(tree):
        pairs &= now[:, earlier][:, None] != now[:, earlier][None, :]
    if level < LABEL and pairs.any():
        longer = prefixes(keys, level + 1)
        for own in longer.T:
            pairs &= own[:, None] != own[None, :]
    return pairs


KEYS = ["bucket", "tree", "low", "high"]


def _needed(level: int):
    def need(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members of a group that have a partner in it."""
        columns, found = [*KEYS, "block", "rep"], []
        for group in _runs(batches, KEYS):
            pairs = _first_met(group, level)
            used = pairs.any(axis=0) | pairs.any(axis=1)
            if used.any():
                found.append(group.loc[used, columns])
            if len(found) >= 2000:
                yield pd.concat(found)
                found = []
        if found:
            yield pd.concat(found)
    return need


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of columns that two sets or more have."""
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = np.zeros((count, count), np.float32), 8192
    for first in range(0, int(shared.sum()), width):
        inside = slice(*np.searchsorted(column, [first, first + width]))
        held = np.zeros((count, width), np.float32)
        held[owner[inside], column[inside] - first] = 1
        total += held @ held.T
    return total


def _similar(texts: pd.Series, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """The similarities of the pairs that reach the threshold; 0 elsewhere."""
    used = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
    linked = np.zeros(pairs.shape)
    if not len(used):
        return linked
    sets = [np.unique(shingles(texts.iat[i])) for i in used]
    sizes = np.array([len(s) for s in sets])
    if len(used) > FEW:
        both = _common(sets).astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - both
        linked[np.ix_(used, used)] = np.where(both >= threshold * union - 1e-9, both / union, 0)
        return np.where(pairs, linked, 0)
    place = {u: k for k, u in enumerate(used)}
    for i, j in zip(*np.nonzero(pairs)):
        one, other = place[i], place[j]
        both = len(np.intersect1d(sets[one], sets[other], assume_unique=True))
        union = sizes[one] + sizes[other] - both
        linked[i, j] = both / union if both >= threshold * union - 1e-9 else 0
    return linked


def _verified(threshold: float, level: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of links of each member, and an edge to the first member that it hangs together with; once a
        group, its pairs and how many there are in all for them, by the length of the prefix."""
        found = []
        for group in _runs(batches, KEYS):
            group = group.drop_duplicates("rep")
            alike = _similar(group["text"], _first_met(group, level), threshold)
            known = alike[alike > 0]
            if not len(known):
                continue
            linked = (alike > 0) | (alike > 0).T
            rep, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
            label = np.arange(len(group))
            while True:
                least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
                if (least == label).all():
                    break
                label = least
            some = np.flatnonzero(linked.any(axis=1))
            made = pd.DataFrame({"rep": rep[some], "root": rep[label][some], "links": (linked @ copies)[some], "pairs": 0})
            made.loc[0, "pairs"] = len(known)
            weights = [float((1 / met(known, length)).sum()) for length in range(1, level + 1)]
            made["all"] = [weights] + [None] * (len(made) - 1)
            found.append(made)
            if len(found) >= 2000:
                yield pd.concat(found)
                found = []
        if found:
            yield pd.concat(found)
    return verify


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition(*KEYS).sortWithinPartitions(*KEYS)


def _nodes(reps: DataFrame, level: int) -> DataFrame:
    """The bucket of each text in each tree, at this length of the prefix."""
    width = 2 * LABEL
    return reps.withColumn("node", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("trees", 1 + t * width, 2 * level)).alias("bucket"))
        for t in range(TREES)]))).select("*", "node.tree", "node.bucket").drop("node")


def _in_company(reps: DataFrame, level: int) -> DataFrame:
    """The texts that are not alone in all their buckets of this length, and in ``live``, a bit a tree, where they are not.

    Who is alone with a prefix is alone with a longer one, so the longer ones ask nobody else.
    """
    entries = _nodes(reps.select("rep", "trees"), level).drop("trees")
    buckets = cut_lineage(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"))
    live = cut_lineage(meet(entries, buckets, ["bucket"], "left_semi").groupBy("rep").agg(
        F.bit_or(F.expr("shiftleft(1, tree)")).alias("live")))
    return cut_lineage(meet(reps, live, ["rep"]).filter("live IS NOT NULL"))


def _met_first(reps: DataFrame, bodies: DataFrame, level: int, threshold: float) -> DataFrame:
    """Links of the pairs that meet at this length of the prefix and at no longer one; ``reps`` are in company."""
    entries = _nodes(reps.select("rep", "bytes", "trees", "live"), level).filter(
        "getbit(live, tree) = 1").select("rep", "bytes", "tree", "bucket")
    buckets = cut_lineage(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("weight")).filter("n > 1"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("weight") / BLOCK_BYTES)).cast("int")
    members = entries.drop("bytes").join(buckets, "bucket").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "tree", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep")
    needed = cut_lineage(_grouped(members.join(reps.select("rep", "trees"), "rep")).mapInPandas(
        _needed(level), "bucket long, tree int, low int, high int, block int, rep long"))
    wanted = cut_lineage(needed.select("rep").distinct().join(reps.select("rep", "key", "sha"), "rep").select(
        F.col("sha").alias("_sha"), F.xxhash64("key").alias("_mark"), "key", "rep"))
    # only texts that may have a partner are moved; keys may be null
    texts = meet(bodies, wanted, ["_sha", "_mark"]).filter(F.col("rep").isNotNull() & F.col("_key").eqNullSafe(F.col("key")))
    texts = texts.groupBy("rep").agg(F.first("text").alias("text"))  # rows with one id and text bring it once
    full = needed.join(reps.select("rep", "copies", "trees"), "rep").join(texts, "rep")
    return cut_lineage(_grouped(full).mapInPandas(
        _verified(threshold, level), "rep long, root long, links long, pairs long, all array<double>"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD,
            recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: ``row``, ``key``, ``sha``, ``rep`` (the row that stands for its copies), ``links`` (number of
    other rows with at least the similarity, copies among them), ``class_id`` (least key of the class) and ``leader_rep`` (its row)."""
    body = F.coalesce(F.col(text), F.lit(""))

    @F.pandas_udf("binary")
    def signed(column: pd.Series) -> pd.Series:
        return column.map(signature)

    rows = cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.unhex(F.sha2(body, 256)).alias("sha"),
        F.octet_length(body).alias("bytes"), signed(body).alias("trees")))
    copies = cut_lineage(rows.groupBy("sha").agg(
        F.min("row").alias("rep"), F.min("key").alias("least"), F.count(F.lit(1)).alias("copies")))
    reps = cut_lineage(rows.drop("sha").join(copies, F.col("row") == F.col("rep")).filter(
        F.col("trees").isNotNull()).select("rep", "sha", "key", "bytes", "copies", "trees"))
    bodies = docs.select(F.col(key).alias("_key"), F.xxhash64(key).alias("_mark"), F.unhex(F.sha2(body, 256)).alias("_sha"), body.alias("text"))
    last, met_at, reached = depth(threshold, recall), [], 0.0
    reps = _in_company(reps, last)
    for level in range(LABEL, last - 1, -1):
        met_at.append(_met_first(reps, bodies, level, threshold))
        pairs, there = reduce(DataFrame.unionByName, met_at).agg(F.sum("pairs"), F.sum(F.element_at("all", level))).first()
        reached = pairs / there if pairs else 0.0
        if reached >= recall:
            break
    verified = reduce(DataFrame.unionByName, met_at)

    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(verified, "rep", "root").withColumnRenamed("node", "rep")
    known = cut_lineage(copies.join(links, "rep", "left").join(roots, "rep", "left").select(
        "sha", "rep", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root")))
    first = cut_lineage(known.groupBy("root").agg(
        F.min(F.struct(F.col("least").isNull().alias("none"), "least", "rep")).alias("first")))
    known = cut_lineage(known.join(first, "root").select(
        "sha", "rep", (F.col("links") + F.col("copies") - 1).alias("links"), F.col("first.least").alias("class_id"),
        F.col("first.rep").alias("leader_rep")))
    return rows.select("row", "key", "sha").join(known, "sha")


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Each row with its class, the least key of what hangs together with it, and its number of links."""
    return classes(docs, text, key, threshold).select(F.col("key").alias(key), "class_id", F.col("links").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all its columns: the one with the least key."""
    found = classes(docs, text, key, threshold)
    # of the copies of the leading text, the row with the class's key; of several, one
    stay = found.filter((F.col("rep") == F.col("leader_rep")) & F.col("key").eqNullSafe(F.col("class_id"))).select("key", "sha").distinct()
    body = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    named = docs.select(F.col(key).alias("_key"), body.alias("_sha"), F.struct("*").alias("rest"))
    same = (F.col("_sha") == F.col("sha")) & F.col("_key").eqNullSafe(F.col("key"))
    one = Window.partitionBy("_sha", "_key").orderBy(F.lit(1))
    return named.join(stay, same, "left_semi").withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").select("rest.*")
