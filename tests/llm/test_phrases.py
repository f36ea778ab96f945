"""Collocations against a plain count of everything."""

import re
from collections import Counter, defaultdict

import pytest

from mendwell.llm import phrases


def brute(rows, top=2000, least=10):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        kept = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in kept.items() if len(p) == 3 for q in (p[:2], p[1:]) if q in kept and 100 * a >= 50 * kept[q]}
        ranked = []
        for p in kept.keys() - inside:
            a = kept[p]
            score, k = min((1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def some(spark, rows, **extra):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, phrase int, a int")


NEW = "New York City, is new york city. And the new  york\tTimes! the the the the times of the of the"


@pytest.mark.parametrize("levels, top", [((0,), 5), ((900_000, 300_000, 0), 1), ((500_000, 0), 2000)])
def test_levels_change_nothing(spark, levels, top):
    rows = [("en", NEW)] * 7 + [("en", "x y z. a b"), ("en", "x y z a b")] * 6 + [(None, "ä ö ü Ä")] * 12 + [("und", "ä ö")] * 3
    rows += [("de", None), ("de", ""), (None, None), ("fr", " ,. \t\n"), ("fr", "un deux")]
    got = rows_of(phrases.mine(some(spark, rows), top=top, least=3, levels=levels))
    assert got == brute(rows, top, 3)
    assert {r[0] for r in got} == {"en", "und"}


def test_portions_overlap(monkeypatch):
    text = ("A b, c. " * 40 + "\t" + "d" * 300 + " e" * 50).encode()
    whole = [w for words, known in phrases.portions([text], 10**6) for w in words[known:]]
    for size in (1, 7, 64):
        parts = list(phrases.portions([text, b"x", text], size))
        fresh = [w for words, known in parts for w in words[known:]]
        assert [w for w in fresh if w != phrases.BREAK] == [w for w in whole if w != phrases.BREAK] + [b"x"] + [
            w for w in whole if w != phrases.BREAK]
        assert all(known <= 2 for _, known in parts)


def test_long_texts_in_small_portions(spark, monkeypatch, odd_docs, odd_rows):
    def small(texts, size=None, portions=phrases.portions):
        return portions(texts, 100)

    monkeypatch.setattr(phrases, "portions", small)
    rows = [(r[2], r[1]) for r in odd_rows] * 2
    got = rows_of(phrases.mine(odd_docs.union(odd_docs), least=2, levels=(200_000, 0), buckets=7))
    assert got == brute(rows, 2000, 2)


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000_001, 3_000_000_000_002, 3_000_000_000_005)], "a long, l long, r long")
    a, left, right = 3_000_000_000_001, 3_000_000_000_002, 3_000_000_000_005
    assert df.select(phrases._score("a", "l", "r")).first()[0] == 1_000_000 * a * a // (left * right)


def test_empty_table_and_levels(spark, no_docs):
    made = phrases.mine(no_docs)
    assert made.collect() == [] and made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    with pytest.raises(ValueError):
        phrases.mine(no_docs, levels=(5, 10, 0))
