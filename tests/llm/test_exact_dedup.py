import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mendwell.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    out = Counter()
    for text, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        sha, spent = hashlib.sha256(text.encode()).hexdigest(), False
        for key in keys:
            stays = key == best and not spent
            spent |= stays
            out[key, best, len(keys), stays, sha] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("block", [4, 64, 8192])
def test_odd_rows(odd_docs, odd_rows, block):
    assert found(exact_dedup.report(odd_docs, block_bytes=block)) == expected([r[:2] for r in odd_rows])


def test_a_table(tiny_docs):
    rows = [tuple(r) for r in tiny_docs.select("doc_id", "text").collect()]
    assert found(exact_dedup.report(tiny_docs, block_bytes=256)) == expected(rows)


def test_blocks_that_share_an_address_are_addressed_anew(odd_docs, odd_rows, monkeypatch):
    sound, seeds = exact_dedup._address, []

    def weak(block, seed):
        seeds.append(seed)
        return [F.pmod(a, F.lit(3)) for a in sound(block, seed)] if seed == 0 else sound(block, seed)

    monkeypatch.setattr(exact_dedup, "_address", weak)
    assert found(exact_dedup.report(odd_docs, block_bytes=32)) == expected([r[:2] for r in odd_rows])
    assert max(seeds) == 1


def test_dropping_keeps_columns(odd_docs, odd_rows, no_docs):
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.select("doc_id", "text").collect()
    assert sorted((r.text or "") for r in rows) == sorted({r[1] or "" for r in odd_rows})
    assert {r.doc_id for r in rows if r.text == "a"} == {5}
    assert exact_dedup.drop_duplicates(no_docs).count() == 0 and exact_dedup.report(no_docs).count() == 0
