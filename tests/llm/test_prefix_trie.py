"""The prefix trie against one built node by node."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from mendwell.llm import prefix_trie

EMPTY = sha256(b"").hexdigest()


def rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), name, (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(sequences):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, own in members.items():
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(own) - 1) * (len(path[-1][1]) if path else 0)
    return sorted((
        min(own), len(path), min(members[path[:-1]]) if path else -1, len(own), children.get(path, 0), leaves[path], saved[path],
        sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest(),
    ) for path, own in members.items())


def rows_of(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def some(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows],
                                 "conv_id long, turn long, role string, text string, n long, part int, path string")


def random_rows(seed, convs, words, most):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-300, 40_000), convs):
        for t in range(rng.randint(0, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), "x" * rng.randint(0, words)))
    return rows + [(c, t, "user", "same") for c in range(50_000, 50_600) for t in range(9)]


@pytest.mark.parametrize("seed, convs, words, most, count", [(1, 300, 1, 6, 8), (2, 400, 2, 12, 97)])
def test_equals_a_trie_built_by_hand(spark, monkeypatch, seed, convs, words, most, count):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = random_rows(seed, convs, words, most)
    random.Random(seed).shuffle(rows)
    made = prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.own_turns(some(spark, rows))), part_rows=-(-len({r[0] for r in rows}) // count))
    want = brute(rebuild(rows))
    assert rows_of(made) == want
    assert max(r[3] for r in want[1:]) >= 600 and made.columns == [f.split()[0] for f in prefix_trie.NODES.split(", ")]


def test_odd_rows(spark):
    long = "word " * 20_000
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "user", ""), (None, 1, "user", "x"), (None, None, None, None),
            (100, 3, "a", "bc"), (100, 3, "ab", "c"), (100, 3, "a", "bc"), (101, 0, "ü", long), (105, 0, "u", "t"), (-7, 0, "u", "é漢😀")]
    rows += [(300, t, "user", str(t % 3)) for t in range(700)] + [(301, t, "user", str(t % 3)) for t in range(650)]
    assert rows_of(prefix_trie.report(some(spark, rows))) == brute(rebuild(rows))


def test_one_conversation_and_none(spark):
    assert rows_of(prefix_trie.report(some(spark, [(7, 0, "u", "ab")]))) == brute(rebuild([(7, 0, "u", "ab")]))
    assert prefix_trie.report(some(spark, []).limit(0)).collect() == []


def test_searches_by_range_minima():
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 64, 100):
        values = rng.integers(0, 5, size)
        table = prefix_trie.sparse(values)
        start, depth = np.arange(size).repeat(7), np.tile(np.arange(7), size)
        right = prefix_trie.reach(table, start, depth, 1)
        left = prefix_trie.reach(table, start, depth, -1)
        for s, d, r, a in zip(start, depth, right, left):
            want = s
            while want + 1 < size and values[want + 1] >= d:
                want += 1
            assert r == want
            want = s
            while want > 0 and values[want] >= d:
                want -= 1
            assert a == want
