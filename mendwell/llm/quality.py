"""A quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over the features, one feature at a time, on the
histogram of its bins; what they add up to is one lookup table a feature. Then pairs of
features are chosen by what a cut of both explains of the rest, and get tables of their
own in the same way. A score is the sum of looked-up values through a logistic function.

Learning uses a bounded sample: at most ``SAMPLE`` labelled documents, the first ones by hash of
their id. Their features are computed by Spark and gathered on the driver (``SAMPLE`` rows of
``len(FEATURES)`` numbers). Scoring is one pass over whole texts.

Labels of one document are averaged; null labels are left out. Null texts count as empty and
are scored like others. Without labels every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PATIENCE = 300, 120, 25
PAIRS = 6
RATE, RIDGE = 0.1, 1.0
ACCEPT = 0.3
FOLDS = 5

FEATURES = (
    "words", "word_length", "capitals", "marks", "digits", "distinct_words", "top_word", "distinct_pairs", "distinct_lines",
    "stutter", "odd_ends", "capital_words", "line_words", "longest_word", "common_words", "wide_marks",
)
# Frequent words of the languages of the corpus.
COMMON = frozenset(
    "the of and to in a is that for it was on with as are by this be from der die und das den von zu mit ist des auf für "
    "im dem nicht ein eine de la le et les des en un une du que est pour dans el los las y del se por con para una".split())

_KIND = np.zeros((256, 4))
_KIND[[*range(97, 123), *range(128, 256)], 0] = 1
_KIND[65:91, 1] = 1
_KIND[48:58, 2] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()], 3] = 1
_WIDE = np.array([ord(c) for c in "#$%&*|<>{}=~^_\\@!"])


def features(text: str | None) -> list[float]:
    text = text or ""
    bytes_seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    small, capital, digit, mark = bytes_seen @ _KIND
    solid = max(small + capital + digit + mark, 1)
    words = text.split()
    count = len(words)
    lines = [line for line in text.split("\n") if line.strip()]
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(count), sum(map(len, words)) / max(count, 1), capital / max(small + capital, 1), mark / solid, digit / solid,
        len(seen) / max(count, 1), max(seen.values(), default=0) / max(count, 1), pairs / max(count - 1, 1),
        len(set(lines)) / max(len(lines), 1), sum(map(str.__eq__, words, words[1:])) / max(count - 1, 1),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in words) / max(count, 1),
        sum(n for w, n in seen.items() if len(w) > 1 and w.isupper()) / max(count, 1), np.log1p(count / max(len(lines), 1)),
        np.log1p(max(map(len, seen), default=0)), sum(n for w, n in seen.items() if w.lower() in COMMON) / max(count, 1),
        bytes_seen[_WIDE].sum() / solid,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _cut(gain: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Best place to cut a histogram in two, and what it gains."""
    left, heavy = np.cumsum(gain)[:-1], np.cumsum(weight)[:-1]
    whole, total = gain.sum(), weight.sum()
    if not len(left):
        return 0.0, 0
    won = left**2 / (heavy + RIDGE) + (whole - left) ** 2 / (total - heavy + RIDGE) - whole**2 / (total + RIDGE)
    at = int(np.argmax(won))
    return float(won[at]), at + 1


def _tree(gain: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Step for each bin from a tree of depth 2."""
    edges = [0, _cut(gain, weight)[1], len(gain)]
    inner = [a + _cut(gain[a:b], weight[a:b])[1] for a, b in zip(edges, edges[1:]) if b - a > 1]
    edges = sorted({*edges, *inner})
    step = np.zeros(len(gain))
    for a, b in zip(edges, edges[1:]):
        step[a:b] = RATE * gain[a:b].sum() / (weight[a:b].sum() + RIDGE)
    return step


def _pair_tree(gain: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Step for each cell: a cut of one feature, and on either side one of the other."""
    best = None
    for turned in (False, True):
        g, w = (gain.T, weight.T) if turned else (gain, weight)
        at = _cut(g.sum(1), w.sum(1))[1]
        step, won = np.zeros(g.shape), 0.0
        for rows in (slice(0, at), slice(at, None)):
            got, cut = _cut(g[rows].sum(0), w[rows].sum(0))
            won += got
            for columns in (slice(0, cut), slice(cut, None)):
                step[rows, columns] = RATE * g[rows, columns].sum() / (w[rows, columns].sum() + RIDGE)
        if best is None or won > best[0]:
            best = won, step.T if turned else step
    return best[1]


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"),
                           np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return _sigmoid(total)


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Deterministic; a seventh of the rows only decides when to stop."""
    model = Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if not len(y):
        return model
    probe = np.arange(len(y)) % 7 == 6
    fit = ~probe
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(total)
        return np.where(fit, y - p, 0.0), np.where(fit, p * (1 - p), 0.0)

    def loss() -> float:
        held = probe if probe.any() else fit
        p = np.clip(_sigmoid(total[held]), 1e-9, 1 - 1e-9)
        return float(-(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean())

    def cells(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        return coarse[i] * shape[1] + coarse[j], shape

    def rounds(most: int, tables: list[np.ndarray], turn) -> None:
        nonlocal total
        least, kept, waited = loss(), ([t.copy() for t in tables], total.copy()), 0
        for _ in range(most):
            turn()
            now = loss()
            if now < least - 1e-6:
                least, kept, waited = now, ([t.copy() for t in tables], total.copy()), 0
            elif (waited := waited + 1) >= PATIENCE:
                break
        for table, best in zip(tables, kept[0]):
            table[:] = best
        total = kept[1]

    def mains() -> None:
        nonlocal total
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = _tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)))
            table += step
            total += step[bins[j]]

    rounds(ROUNDS, model.tables, mains)

    g, h = slopes()
    ranked = []
    for i, j in combinations(range(x.shape[1]), 2):
        cell, shape = cells(i, j)
        gain = np.bincount(cell, g, shape[0] * shape[1]).reshape(shape)
        weight = np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)
        step = _pair_tree(gain, weight)
        ranked.append((float((step * gain).sum()), i, j))
    model.pairs = [(i, j, np.zeros(cells(i, j)[1])) for _, i, j in sorted(ranked, reverse=True)[:PAIRS]]

    def twos() -> None:
        nonlocal total
        for i, j, table in model.pairs:
            cell, shape = cells(i, j)
            g, h = slopes()
            step = _pair_tree(np.bincount(cell, g, table.size).reshape(shape), np.bincount(cell, h, table.size).reshape(shape))
            table += step
            total += step.reshape(-1)[cell]

    rounds(PAIR_ROUNDS, [t for _, _, t in model.pairs], twos)
    return model


def fold(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        sample: int = SAMPLE) -> Model:
    """A model from documents whose ``fold`` is not 0."""
    @F.pandas_udf("array<double>")
    def feature_column(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    marked = labels.filter(F.col(label).isNotNull() & (fold(key) != 0)).groupBy(F.col(key).alias("_key")).agg(
        F.avg(F.col(label).cast("double")).alias("y"))
    chosen = F.broadcast(marked.orderBy(F.xxhash64("_key"), "_key").limit(sample))  # at most ``sample`` rows
    known = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("body")).join(chosen, "_key")
    rows = known.select("_key", "y", feature_column("body").alias("x"))
    got = rows.orderBy(F.xxhash64("_key"), "_key", "x").limit(sample).collect()
    return train(np.array([r["x"] for r in got], dtype=float).reshape(len(got), len(FEATURES)), np.array([r["y"] for r in got], dtype=float))


def scored(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        return pd.Series(model.score(x))

    return score


def report(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    score = scored(fit(docs, labels, text, key))
    return docs.select(
        F.col(key).alias(key), F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out"),
        score(F.coalesce(F.col(text), F.lit(""))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    score = scored(fit(docs, labels, text, key))
    rows = docs.select(F.struct("*").alias("rest"), score(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return rows.filter(F.col("score") >= ACCEPT).select("rest.*")
