from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from mendwell import session
from mendwell.llm import near_dups
from mendwell.llm.components import components


def runs(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(key, class, links) of each row, by comparing all pairs."""
    sets, root, links = [runs(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        same = (rows[i][1] or "") == (rows[j][1] or "")
        both = len(sets[i] & sets[j])
        if same or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            links[i] += 1
            links[j] += 1
            root[top(j)] = top(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        old = least.get(top(i))
        least[top(i)] = key if old is None else old if key is None else min(old, key)
    return Counter((key, least[top(i)], links[i]) for i, (key, _) in enumerate(rows))


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "class_id", "n_links").collect())


def test_odd_rows(odd_docs, odd_rows):
    assert found(near_dups.report(odd_docs)) == brute([r[:2] for r in odd_rows])


def test_a_table(tiny_docs):
    assert found(near_dups.report(tiny_docs)) == brute([tuple(r) for r in tiny_docs.select("doc_id", "text").collect()])


def test_a_large_class_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 8)
    draw = np.random.RandomState(1)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in draw.choice(300, draw.randint(0, 5), replace=False):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"r{i}v{j}" for j in range(40))) for i in range(20)]
    got = found(near_dups.report(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute(rows)
    assert Counter({(k, c): n for (k, c, _), n in got.items()}) == Counter({(k, c): n for (k, c, _), n in want.items()})
    total = sum(links * n for (_, _, links), n in want.items())
    assert total * near_dups.RECALL <= sum(links * n for (_, _, links), n in got.items()) <= total


def test_dropping_keeps_one_of_a_class(odd_docs, odd_rows, no_docs):
    kept = near_dups.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    classes = {c for _, c, _ in brute([r[:2] for r in odd_rows])}
    rows = kept.select("doc_id").collect()
    assert len(rows) == len(classes) and {r.doc_id for r in rows} == classes
    assert near_dups.drop_near_duplicates(no_docs).count() == 0 and near_dups.report(no_docs).count() == 0


def test_prefixes_are_shortened_until_the_recall(spark, monkeypatch):
    """Alike pairs end it at the whole key; pairs near the threshold ask for shorter prefixes, down to the last one."""
    levels, real = [], near_dups._met_first
    monkeypatch.setattr(near_dups, "_met_first", lambda *args: levels.append(args[2]) or real(*args))
    draw = np.random.RandomState(2)

    def copies(changed, count=60):
        rows = []
        for i in range(count):
            words = [f"t{i}w{j}" for j in range(200)]
            other = list(words)
            for at in draw.choice(200, changed, replace=False):
                other[at] = "new"
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        return rows

    seen = {}
    for changed in (1, 4):
        rows, levels[:] = copies(changed), []
        got = found(near_dups.report(spark.createDataFrame(rows, "doc_id long, text string")))
        want = brute(rows)
        linked = [sum(n for (_, _, links), n in some.items() if links) for some in (got, want)]
        assert linked[1] >= 20 and linked[1] * 0.97 <= linked[0] <= linked[1]
        seen[changed] = list(levels)
    assert seen[1] == [8] and seen[4][:2] == [8, 7] and min(seen[4]) >= near_dups.depth()


def test_keys_have_the_prefixes_of_their_minima():
    keys = [near_dups.signature(t) for t in ("a b c d e f g", "a b c d e f g", "a b c d e f h")]
    assert {len(k) for k in keys} == {2 * near_dups.LABEL * near_dups.TREES}
    for level in (1, 5, 8):
        made = near_dups.prefixes(keys, level)
        own = [[k[16 * t:16 * t + 2 * level] for t in range(near_dups.TREES)] for k in keys]
        assert (made[0] == made[1]).all()
        assert [a == b for a, b in zip(own[0], own[2])] == (made[0] == made[2]).tolist()


def test_depth_gives_the_recall():
    length = near_dups.depth()
    assert 1 - (1 - 0.8**length) ** near_dups.TREES >= near_dups.RECALL > 1 - (1 - 0.8 ** (length + 1)) ** near_dups.TREES
    assert near_dups.depth(0.1) == 1


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50)]])
def test_components(spark, edges):
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((i, top(i)) for i in root)


def test_the_text_of_repeated_rows_comes_once(spark, monkeypatch):
    real = near_dups._verified

    def watched(*args):
        def verify(batches):
            def once():
                for batch in batches:
                    assert not batch.duplicated([*near_dups.KEYS, "rep"]).any()
                    yield batch
            yield from real(*args)(once())
        return verify

    monkeypatch.setattr(near_dups, "_verified", watched)
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in "ab"]
    rows = [(7, texts[0])] * 40 + [(None, texts[1])] * 40 + [(8, texts[0] + " end"), (9, texts[1] + " end"), (5, texts[0])]
    assert found(near_dups.report(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def pairs_and_lone(pairs=6, lone=300):
    """Near copies, some with null ids or in repeated rows, and many texts without a partner."""
    rows = []
    for i in range(pairs):
        words = [f"p{i}w{j}" for j in range(60)]
        rows += [(None if i == 0 else 2 * i, " ".join(words)), (2 * i + 1, " ".join(words + ["end"]))]
    return rows + rows[-2:] + [(1000 + i, " ".join(f"l{i}w{j}" for j in range(30))) for i in range(lone)]


@pytest.mark.parametrize("few", [True, False])
def test_lone_texts_stay_where_they_are(spark, monkeypatch, few):
    """No length of the prefix asks texts that are alone at the last one, and their text is not moved, however many have a partner."""
    asked, moved, real, split = [], [], near_dups._met_first, session.split_by
    monkeypatch.setattr(near_dups, "_met_first", lambda reps, *args: asked.append(reps.count()) or real(reps, *args))

    def watched(df, *args):
        near, far = split(df, *args)
        if "text" in df.columns:
            moved.append(near.count())
        return near, far

    monkeypatch.setattr(session, "split_by", watched)
    if not few:
        monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    rows = pairs_and_lone()
    assert found(near_dups.report(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert asked and max(asked) == 12
    assert len(moved) == (0 if few else len(asked)) and all(n < 30 for n in moved)


def test_company_at_the_last_length_holds_that_of_longer_ones(spark):
    texts = [" ".join(f"t{i // 4}w{j}" if j % 50 >= i % 4 else f"o{i}w{j}" for j in range(100)) for i in range(40)]
    reps = spark.createDataFrame([(i, bytearray(near_dups.signature(t))) for i, t in enumerate(texts)], "rep long, trees binary")
    live = {r.rep: r.live for r in near_dups._in_company(reps, 5).collect()}
    for level in (5, 6, 8):
        made = near_dups.prefixes([near_dups.signature(t) for t in texts], level)
        for tree in range(near_dups.TREES):
            values, times = np.unique(made[:, tree], return_counts=True)
            met = {i for i in range(len(texts)) if times[np.searchsorted(values, made[i, tree])] > 1}
            there = {rep for rep, bits in live.items() if bits >> tree & 1}
            assert met <= there and (level > 5 or met == there)
