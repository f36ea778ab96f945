"""Phrases whose words go together, per language, by best-first branch and bound.

The score of a phrase cut in two is a*a / (l*r) in millionths, with the counts of the phrase and of
its two parts; the lowest of its cuts is the score of the phrase. A phrase occurs no more often than
any word in it, so counts of words alone bound scores from above:

    two words     x y      at most  min(x, y) / max(x, y)
    three words   x y z    at most  min(x, y, z) / max(x, z)

The frontier is opened from the best bounds downwards, level by level. At a level all phrases whose
bound reaches it are counted, and no others: what lies below cannot score so high. Grown phrases
narrow their bounds by their own counts, those that still reach the level get the exact counts of
their parts, and a phrase inside a longer one is dropped as soon as the longer one is frequent enough.
A language is settled once ``top`` survivors reach the level, ties included; the others go on with
the next level, and the last level, 0, bounds nothing.

Tasks count n-grams of a few megabytes of text at a time; what they need to know of the whole corpus
is of a fixed size: the least and the largest count of the words in each of ``BUCKETS`` buckets, and bit sets
of ``BITS`` phrases. Both only let too much through, never too little; exact joins follow.

Null languages are ``und``, null texts are empty, repeated rows count as often as they are there. Texts of
any length are read in portions that overlap by two words. An empty table gives an empty result, and other
columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.session import cut_lineage, small_side

TOP = 2000
LEAST = 10
MILLION = 1_000_000
LEVELS = (100_000, 1_000, 0)
BUCKETS = 1 << 20
BITS = 67_108_859  # a prime just below 2**26
MIX = (1_000_003, 69_069)
PORTION = 1 << 20  # bytes of text that are counted at a time
SPREAD = 64
ROWS = 256

BREAK = b"\xff"  # in no UTF-8 text
_TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))

Counted = Iterator[tuple[np.ndarray, np.ndarray]]


def _tokens(data: bytes) -> bytes:
    """Lower-cased words and breaks, with spaces between."""
    return data.lower().translate(_TABLE).replace(BREAK, b" " + BREAK + b" ")


def portions(texts: Sequence[bytes], size: int = PORTION) -> Iterator[tuple[list[bytes], int]]:
    """Words and breaks of the texts, and how many of the first ones were in the portion before."""
    held: list[bytes] = []
    weight = 0
    for text in texts:
        if len(text) <= size:
            held.append(text)
            weight += len(text)
            if weight < size:
                continue
        if held:
            yield _tokens((b" " + b"\n" + b" ").join(held)).split(), 0
            held, weight = [], 0
        if len(text) > size:
            data, start, carry = _tokens(text), 0, []
            while start < len(data):
                end = data.find(b" ", start + size)
                end = len(data) if end < 0 else end
                words = carry + data[start:end].split()
                yield words, len(carry)
                start, carry = end, words[-2:]
    if held:
        yield _tokens((b" " + b"\n" + b" ").join(held)).split(), 0


class Portion:
    """One portion as numbers of its distinct words."""

    def __init__(self, lang: str, words: list[bytes], known: int):
        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = np.array(coded.dictionary.to_pylist() + [b""], dtype=object)[:-1]
        self.known = known
        self.real = self.vocabulary != BREAK
        self.start = zlib.crc32(lang.encode() + b" ")

    def crc(self) -> np.ndarray:
        return np.fromiter((zlib.crc32(word, self.start) for word in self.vocabulary), np.int64, len(self.vocabulary))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(self.ids[self.known:], minlength=len(self.vocabulary))
        seen = np.flatnonzero((counts > 0) & self.real)
        return self.vocabulary[seen], counts[seen]

    def count(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct phrases that begin at the places, and how often they do."""
        ids, size = self.ids, len(self.vocabulary)
        keys, counts = np.unique(ids[places] * size + ids[places + 1], return_counts=True) if length == 2 else (None, None)
        if length == 3:
            pairs, inner = np.unique(ids[places] * size + ids[places + 1], return_inverse=True)
            keys, counts = np.unique(inner.astype(np.int64) * size + ids[places + 2], return_counts=True)
            firsts = pairs[keys // size]
            head = self.vocabulary[firsts // size] + b" " + self.vocabulary[firsts % size]
        else:
            head = self.vocabulary[keys // size]
        return head + b" " + self.vocabulary[keys % size], counts

    def places(self, length: int, good: np.ndarray) -> np.ndarray:
        """Where phrases of good words begin that do not end in the portion before."""
        ok = good[self.ids]
        fit = reduce(np.logical_and, [ok[k:len(ok) - length + 1 + k] for k in range(length)]) if len(ok) >= length else ok[:0]
        found = np.flatnonzero(fit)
        return found[found + length > self.known]


def _counts(docs: DataFrame, count: Callable[[Portion], Counted]) -> DataFrame:
    """``lang``, ``phrase``, ``a``: what ``count`` finds in the portions of a task, summed up over all tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(start, ROWS) for whole in batches for start in range(0, whole.num_rows, ROWS)):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for words, known in portions(own):
                    if len(words) > known:
                        for phrases, counts in count(Portion(lang, words, known)):
                            if len(phrases):
                                yield pa.RecordBatch.from_arrays([
                                    pa.array([lang] * len(phrases), pa.string()),
                                    pa.array(phrases.tolist(), pa.binary()).cast(pa.string()),
                                    pa.array(counts.astype(np.int64)),
                                ], names=["lang", "phrase", "a"])

    found = docs.mapInArrow(work, "lang string, phrase string, a long")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def count_words(docs: DataFrame) -> DataFrame:
    return _counts(docs, lambda portion: iter([portion.words()]))


def _crc(word: Column | str) -> Column:
    word = F.col(word) if isinstance(word, str) else word
    return F.crc32(F.concat(F.col("lang"), F.lit(" "), word).cast("binary"))


def _ranges(words: DataFrame, buckets: int) -> np.ndarray:
    """Least and largest count of the frequent words in each bucket, 0 where there are none."""
    rows = words.groupBy((_crc("phrase") % buckets).cast("int").alias("bucket")).agg(
        F.min("a").alias("low"), F.max("a").alias("high")).toArrow()  # one row a bucket
    table = np.zeros((2, buckets), np.int64)
    table[:, rows["bucket"].to_numpy()] = rows["low"].to_numpy(), rows["high"].to_numpy()
    return table


def _bit_set(pairs: DataFrame) -> np.ndarray:
    """Bits of two-word phrases; ``pairs`` has ``lang``, ``x`` and ``y``."""
    bit = (_crc("x") * MIX[0] + _crc("y") * MIX[1]) % BITS + 1
    maps = pairs.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("position")).groupBy(
        "bucket").agg(F.bitmap_construct_agg("position").alias("bits")).collect()  # at most 2,048 rows of 4 kB
    out = np.zeros(BITS // 8 + 4096, np.uint8)
    for row in maps:
        start = (row["bucket"] - 1) * 4096
        out[start:start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _has(bits: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    bit = (first * MIX[0] + second * MIX[1]) % BITS
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def _open_frontier(docs: DataFrame, ranges, level: int) -> DataFrame:
    """All phrases of two and three words whose bound reaches the level, with their counts."""
    share = level / MILLION * (1 - 1e-9)

    def count(portion: Portion) -> Counted:
        low, high = ranges.value[:, portion.crc() % ranges.value.shape[1]].astype(float)
        good, ids = portion.real & (high > 0), portion.ids
        at = portion.places(2, good)
        x, y = ids[at], ids[at + 1]
        at = at[np.minimum(high[x], high[y]) >= share * np.maximum(low[x], low[y])]
        yield portion.count(at, 2)
        at = portion.places(3, good)
        x, y, z = ids[at], ids[at + 1], ids[at + 2]
        least = np.minimum(np.minimum(high[x], high[y]), high[z])
        yield portion.count(at[least >= share * np.maximum(low[x], low[z])], 3)

    return _counts(docs, count)


def _count_relatives(docs: DataFrame, ranges, parts, tops) -> DataFrame:
    """Two-word phrases of the set ``parts`` and three-word ones that hold one of ``tops``."""

    def count(portion: Portion) -> Counted:
        crc = portion.crc()
        good, ids = portion.real & (ranges.value[1, crc % ranges.value.shape[1]] > 0), portion.ids
        at = portion.places(2, good)
        yield portion.count(at[_has(parts.value, crc[ids[at]], crc[ids[at + 1]])], 2)
        at = portion.places(3, good)
        x, y, z = (crc[ids[at + k]] for k in range(3))
        yield portion.count(at[_has(tops.value, x, y) | _has(tops.value, y, z)], 3)

    return _counts(docs, count)


def _with_count(rows: DataFrame, counts: DataFrame, column: str, name: str) -> DataFrame:
    side = counts.select("lang", F.col("phrase").alias(column), F.col("a").alias(name))
    return rows.join(side, ["lang", column])


def _score(a: str, left: str, right: str) -> Column:
    """Exact: whole division of numbers of 38 digits, for counts below 10**15."""
    return F.expr(
        f"cast({MILLION} as decimal(7,0)) * (cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))"
        f" div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def _part(first: int, last: int) -> Column:
    """Words ``first`` to ``last`` of the phrase, counted from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last - first + 1), " ")


def _inner(rows: DataFrame) -> DataFrame:
    """Both two-word phrases inside three-word ones, as ``part``."""
    return rows.withColumn("part", F.explode(F.array_distinct(F.array(_part(1, 2), _part(2, 3)))))


def _ends(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"x": F.element_at(F.split("phrase", " "), 1), "y": F.element_at(F.split("phrase", " "), -1)})


def _survivors(docs: DataFrame, words: DataFrame, level: int, least: int, buckets: int) -> DataFrame:
    """All phrases of the given languages that score at least ``level`` and are in no frequent longer one."""
    context = docs.sparkSession.sparkContext
    words = words.filter(F.col("a") >= least)
    ranges = context.broadcast(_ranges(words, buckets))
    grown = cut_lineage(_open_frontier(docs, ranges, level).filter(F.col("a") >= least))
    # the counts of the phrases themselves narrow their bounds
    ended = _with_count(_with_count(_ends(grown), words, "x", "fx"), words, "y", "fy")
    long = F.size(F.split("phrase", " ")) == 3
    narrow = F.col("a") * MILLION >= F.greatest("fx", "fy") * F.lit(level)
    ended = cut_lineage(ended.filter(narrow).withColumn("long", long))
    pairs = ended.filter(~F.col("long")).select(
        "lang", "phrase", "x", "y", "a", F.col("fx").alias("l"), F.col("fy").alias("r"), _score("a", "fx", "fy").alias("score"),
    ).filter(F.col("score") >= level)
    triples = ended.filter("long")
    parts = _inner(triples.select("lang", "phrase")).select("lang", F.col("part").alias("phrase")).distinct()
    relatives = grown  # without a bound all phrases are counted already
    if level:
        sets = [context.broadcast(_bit_set(rows)) for rows in (_ends(parts), pairs)]
        relatives = cut_lineage(_count_relatives(docs, ranges, *sets).filter(F.col("a") >= least))
    relatives = relatives.withColumn("long", long)

    holders = _inner(relatives.filter("long")).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    pairs = pairs.drop("x", "y").join(holders, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer") < 50 * F.col("a"), F.lit(True))).drop("longer")
    inside = relatives.filter(~F.col("long"))
    cuts = triples.withColumns({"head": _part(1, 2), "tail": _part(2, 3)})
    cuts = _with_count(_with_count(cuts, inside, "head", "fhead"), inside, "tail", "ftail")
    cut = F.least(*[  # by score, then by place
        F.struct(_score("a", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
        for k, left, right in ((1, "fx", "ftail"), (2, "fhead", "fy"))])
    triples = cuts.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return cut_lineage(pairs.unionByName(triples.filter(F.col("score") >= level)))


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their ``rank``; a language is first thinned out in many tasks."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    thin = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(thin)).filter(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = LEAST,
         levels: Sequence[int] = LEVELS, buckets: int = BUCKETS) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the
    language) and ``score``. ``levels`` fall, the last one is 0."""
    if list(levels) != sorted(set(levels), reverse=True) or levels[-1] != 0:
        raise ValueError("levels must fall to 0")
    own = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = cut_lineage(count_words(own))
    totals = cut_lineage(words.groupBy("lang").agg(F.sum("a").alias("n")))
    settled, left = [], totals.select("lang")
    for level in levels:
        small = small_side(left)
        found = _survivors(own.join(small, "lang", "left_semi"), words.join(small, "lang", "left_semi"), level, least, buckets)
        if level:
            enough = cut_lineage(found.groupBy("lang").count().filter(F.col("count") >= top).select("lang"))
            found = found.join(small_side(enough), "lang", "left_semi")
            left = cut_lineage(left.join(small_side(enough), "lang", "left_anti"))
        settled.append(found)
        if not level or left.isEmpty():
            break
    best = _best(reduce(DataFrame.unionByName, settled), top).join(small_side(totals), "lang")
    return best.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    return mine(docs, text, lang)
