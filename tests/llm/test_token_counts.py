import random

import pytest
from tokenizers import Tokenizer, models, normalizers

from mendwell.llm import token_counts


def reference(pieces, fallback=True):
    made = Tokenizer(models.Unigram([("<unk>", -1e9), *pieces], 0, fallback))
    made.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return made


@pytest.fixture(scope="module")
def pieces():
    return token_counts.load()


def test_a_table_and_odd_texts(pieces, tiny_docs, odd_docs, odd_rows, no_docs):
    want = reference(pieces)
    for docs in (tiny_docs, odd_docs):
        texts = {(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()}
        got = {(r.doc_id, r.n_tokens) for r in token_counts.report(docs).collect()}
        assert got == {(k, len(want.encode(t, add_special_tokens=False).ids)) for k, t in texts}
    assert token_counts.report(odd_docs).count() == len(odd_rows)
    assert token_counts.report(no_docs).count() == 0


def test_ties_and_random_texts(pieces):
    draw, want, own = random.Random(4), reference(pieces), token_counts.Counter(pieces)
    signs = "aaeoutsn  \n\t▁.,<0x1>é漢😀\u200b"
    for _ in range(400):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 60)))
        assert own.count(text) == len(want.encode(text, add_special_tokens=False).ids), repr(text)


@pytest.mark.parametrize("score", [-1.0, -0.3])
def test_small_vocabularies(score):
    """Equal scores, pieces across word borders, no byte pieces."""
    draw = random.Random(5)
    for inner in (False, True):
        vocabulary = [("a", score), ("b", score), ("ab", 2 * score), ("ba", score), ("aab", 3 * score), ("▁", score), ("▁a", score)]
        vocabulary += [("b▁a", score)] if inner else []
        want = Tokenizer(models.Unigram([("<unk>", -9.0), *vocabulary], 0, False))
        want.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        own = token_counts.Counter(vocabulary)
        own.unknown = -9.0 - token_counts.PENALTY
        for _ in range(300):
            text = "".join(draw.choice("aabb c\n") for _ in range(draw.randint(0, 30)))
            assert own.count(text) == len(want.encode(text, add_special_tokens=False).ids), repr(text)


def test_a_very_long_text(pieces):
    own = token_counts.Counter(pieces)
    text = "x" * 200_000 + " the of and" * 150_000
    assert own.count(text) == own.count("x" * 200_000) + 150_000 * own.count("the of and")
