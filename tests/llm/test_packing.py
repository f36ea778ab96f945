from collections import defaultdict

import numpy as np
import pytest

from mendwell.llm import packing


def naive(sizes, permitted):
    """Best fit by looking at every open sequence."""
    rooms, used, since = [], [], []
    left = sum(sizes)
    for now, size in enumerate(sizes):
        left -= size
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fitting:
            at = max((i for room, i in fitting if room == min(fitting)[0]), key=lambda i: since[i])
        else:
            rooms.append(min((c for c in permitted if c >= size), key=lambda c: packing.cost(c) / (size + min(left, c - size))))
            used.append(0)
            since.append(0)
            at = len(rooms) - 1
        rooms[at] -= size
        used[at] += size
        since[at] = now
    return sorted(used)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    sizes = sorted(np.random.RandomState(seed).randint(1, 100, 200).tolist(), reverse=True)
    place, offset = packing.pack(sizes, (16, 32, 64, 100))
    used = np.bincount(place, weights=sizes).astype(int)
    assert sorted(used.tolist()) == naive(sizes, (16, 32, 64, 100))
    for p in set(place):
        inside = sorted((o, s) for q, o, s in zip(place, offset, sizes) if q == p)
        assert [o for o, _ in inside] == np.cumsum([0] + [s for _, s in inside])[:-1].tolist()


def test_joint_choice_is_the_cheapest():
    sizes = np.array([90, 60, 40, 30, 20, 10, 5])
    place, _, capacity = packing.best_pack(sizes, (64, 128))
    spent = sum(packing.cost(c) for c in {p: c for p, c in zip(place, capacity)}.values())
    for permitted in ((64, 128), (128,)):
        other, _ = packing.pack(sizes.tolist(), permitted)
        filled = np.bincount(other, weights=sizes)
        assert spent <= sum(packing.cost(64 if f <= 64 else 128) for f in filled)


def whole(rows, sizes):
    """Pieces cover each document once; sequences hold what they can and are as short as can be."""
    pieces, used = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.piece))
        if r.sequence is None:
            assert r.length == 0 and r.offset is None and r.capacity is None
        else:
            used[r.sequence].append((r.offset, r.length, r.capacity))
    for key, size in sizes.items():
        at = 0
        for nth, (start, length, piece) in enumerate(sorted(pieces[key])):
            assert (start, piece) == (at, nth)
            at += length
        assert at == size
    for inside in used.values():
        at = 0
        for offset, length, _ in sorted(inside):
            assert offset == at
            at += length
        assert {c for *_, c in inside} == {min(c for c in packing.LENGTHS if c >= at)}
    return sum(sizes.values()) / sum(inside[0][2] for inside in used.values())


def test_a_table_in_groups(tiny_docs):
    sizes = {r.doc_id: len(r.text.split()) for r in tiny_docs.select("doc_id", "text").collect()}
    assert whole(packing.report(tiny_docs).collect(), sizes) > 0.9
    whole(packing.report(tiny_docs, group_rows=30).collect(), sizes)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = packing.report(odd_docs).collect()
    unique = {k: len((t or "").split(" ")) for k, t, *_ in odd_rows if k in (7, 8, 10, 13)}
    whole([r for r in rows if r.doc_id == 10 and r.capacity == 4096 and r.length == 4096], {10: 4096 * 4})
    assert {k: sum(r.length for r in rows if r.doc_id == k) for k in unique} == unique
    empty = [r for r in rows if r.length == 0]
    assert len(empty) == sum(not (t or "").split() for _, t, *_ in odd_rows)
    assert packing.report(no_docs).count() == 0
