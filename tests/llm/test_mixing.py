import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from mendwell.llm import mixing


def brute(rows, quality):
    """(key, size, source size, target, taken), by sorting each source whole."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    sized = [(k, t, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, t, s in rows]
    size = Counter()
    for *_, s, n in sized:
        size[s] += n
    total, full, target = 1.5 * sum(size.values()), set(), {}
    while True:
        rest = sum(w for s, w in weight.items() if s not in full)
        level = (total - sum(2 * size[s] for s in full)) / rest if rest else 0
        target = {s: 2.0 * size[s] if s in full else level * w for s, w in weight.items()}
        over = {s for s in sources if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    by = defaultdict(list)
    for k, t, s, n in sized:
        mark = hashlib.md5(f"{'' if k is None else k}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        u = (int(mark[:13], 16) + 0.5) / 2**52
        by[s].append((-math.log(u) / quality.get(k, 1.0), k, n))
    out = Counter()
    for s, docs in by.items():
        epochs = math.floor(target[s] / size[s]) if size[s] else 0
        left, before = target[s] - epochs * size[s], 0
        for _, k, n in sorted(docs, key=lambda d: d[0]):
            out[k, n, size[s], round(target[s], 6), n * (epochs + (left > 0 and before + n / 2 <= left))] += 1
            before += n
    return out


def found(df):
    return Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


@pytest.mark.parametrize("few, slices", [(20_000, 1024), (1, 4)])
def test_against_whole_sorts(tiny_docs, tiny_labels, odd_docs, odd_rows, monkeypatch, few, slices):
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "SLICES", slices)
    quality = mixing.label_weights(tiny_labels)
    weights = {r.key: r.weight for r in quality.collect()}
    rows = [tuple(r) for r in tiny_docs.select("doc_id", "text", "source").collect()]
    assert found(mixing.report(tiny_docs, quality)) == brute(rows, weights)
    assert found(mixing.report(odd_docs)) == brute([(k, t, s) for k, t, _, s, _ in odd_rows], {})


def test_sums_come_near_their_targets(tiny_docs):
    taken, target, largest = Counter(), {}, Counter()
    for r, s in zip(mixing.report(tiny_docs).collect(), tiny_docs.select("doc_id").collect()):
        assert r.taken <= 2 * r["size"]
        taken[r.target, r.source_size] += r.taken
        largest[r.target, r.source_size] = max(largest[r.target, r.source_size], r["size"])
    assert all(abs(n - t) <= largest[t, s] for (t, s), n in taken.items())


def test_the_mix_repeats_rows(tiny_docs, odd_docs, no_docs):
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.report(tiny_docs).collect()}
    mixed = mixing.mix(tiny_docs)
    assert mixed.columns == tiny_docs.columns
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert all(copies[k] == t // n for k, (n, t) in taken.items() if n)
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.report(no_docs).count() == 0


@pytest.mark.parametrize("count", [2, 100])
def test_a_budget_that_ends_with_a_slice(spark, count):
    rows = [(i, f"{i} b c d e f g h i j", "a") for i in range(count)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = found(mixing.report(docs))
    assert got == brute(rows, {})
    assert sum(r[4] * n for r, n in got.items()) == 15 * count
    assert mixing.mix(docs).count() == count * 3 // 2
