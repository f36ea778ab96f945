"""Entity resolution against all pairs and a walk over their links."""

import random

import pytest

from mendwell.operators import entities, groups
from mendwell.operators.entities import Evidence


def brute(rows, weights, score, aliases):
    def plain(value, no):
        text = None if value is None else " ".join(str(value).lower().replace("​", "").split())
        return aliases[no].get(text, text) or None

    norm = [[plain(v, no) for no, v in enumerate(r[1:])] for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sum(w for w, a, b in zip(weights, norm[i], norm[j]) if a is not None and a == b) >= score:
                root[top(i)] = top(j)
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(top(i), []).append(r[0])
    return {k: (min(m), len(m)) for m in members.values() if len(m) > 1 for k in m}


@pytest.mark.parametrize("hot", [5_000_000, 5])
@pytest.mark.parametrize("weights, score", [((2, 1, 1), 3), ((1, 1, 1), 2), ((3, 2, 2), 7)])
def test_entities_against_all_pairs(spark, monkeypatch, weights, score, hot):
    monkeypatch.setattr(groups, "HOT_ROWS", hot)
    rng = random.Random(5)
    names = ["Ann Lee", "ann  lee", " ANN LEE ", "Bo", "bo​", "Cy", "", None, "Dee", "Eve"]
    rows = [(i, rng.choice(names), rng.choice(["de", "Germany", "fr", None, "it"]), rng.choice([1, 2, 3, 4, None])) for i in range(50)]
    rows += [(100 + i, "Hot Row", "de", 9) for i in range(40)] + [(200, None, None, None), (201, None, None, None)]
    df = spark.createDataFrame(rows, "k int, n string, c string, v int").repartition(4)
    aliases = [{}, {"germany": "de"}, {}]
    evidence = [Evidence(c, w, a) for c, w, a in zip("ncv", weights, aliases)]
    got = {r["k"]: (r["entity"]["k"], r["rows_alike"]) for r in entities.resolve(df, ["k"], evidence, score).collect()}
    assert got == brute(rows, weights, score, aliases) and got[100] [1] >= 40
    assert entities.resolve(df.limit(0), ["k"], evidence, score).collect() == []


def test_least_sets():
    assert entities.least_sets([2, 1, 1, 1], 4) == [(0, 1, 2), (0, 1, 3), (0, 2, 3)]
    assert entities.least_sets([5, 1], 5) == [(0,)] and entities.least_sets([1, 1], 3) == []


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50)],
                                   [(i, (i * 7) % 40) for i in range(40)]])
def test_connected(spark, edges):
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    got = entities.connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((i, top(i)) for i in root)
