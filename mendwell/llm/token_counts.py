"""Token counts of a unigram tokenizer, by a Viterbi search that only counts.

An Aho-Corasick automaton lists every piece of the vocabulary that ends at a
position; going through the positions in order, the best score and its number of
pieces are carried for as many positions as the longest piece has characters. Of equal
scores the longer last piece stays, as the first found does where starts are
visited in order. A character without a piece of its own costs the least score less 10
and counts as its bytes if the vocabulary has all byte pieces, else as one for a run.

The text is prepared as such vocabularies want it: spaces become U+2581, and one stands in front.
Where no piece goes on from another character into U+2581, and around white space that
is in no longer piece, a best path is the best paths of its parts; these are looked up
in a bounded memory. That needs scores whose sums are exact (multiples of 1/1024), as
ranks are; with others a text is one part, and only speed differs. A null or empty text has 0 tokens.

The vocabulary is read on the driver by ``load`` (its size is fixed) and goes to the workers with the function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
BYTE_PIECE = "<0x%02X>"
BYTE_SCORE = -1e9  # byte pieces are reached by what has no piece, not by their names
_MEMORY, _SHORT = 1_000_000, 64  # parts remembered by a worker, and their length
_PLAIN, _NEVER = 10_000, float("-inf")


def load(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without its control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), BYTE_SCORE if model.is_byte(i) else model.get_score(i))
        for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]


class Counter(dict):
    """Counts by part of a text; ``count`` gives that of a whole one."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {piece for piece, _ in pieces}
        self.alone = {piece for piece in names if len(piece) == 1}
        self.longest = max(map(len, names), default=1)
        self.unknown = min((score for _, score in pieces), default=0.0) - PENALTY
        self.bytes = all(BYTE_PIECE % i in names for i in range(256))
        joined = {c for piece in names if len(piece) > 1 for c in piece}
        exact = all(float(score * 1024).is_integer() for _, score in pieces)  # else sums depend on where they begin
        if not exact or any(SPACE in piece.lstrip(SPACE) for piece in names):
            self.part = re.compile(".+", re.DOTALL)
        elif apart := "".join(c for c in "\n\t\r\f\v" if c not in joined) if self.bytes else "":
            self.part = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+|[{apart}]")
        else:
            self.part = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __missing__(self, part: str) -> int:
        found = self.search(part)
        if len(part) <= _SHORT:
            if len(self) >= _MEMORY:
                self.clear()
            self[part] = found
        return found

    def _ends(self, text: str) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        """Each position after a character, with the pieces that end there, the longest first."""
        at, found = 0, []
        for end, piece in self.automaton.iter(text):
            while at < end:
                yield at + 1, sorted(found, reverse=True)
                at, found = at + 1, []
            found.append(piece)
        while at < len(text):
            yield at + 1, sorted(found, reverse=True)
            at, found = at + 1, []

    def search(self, text: str) -> int:
        if len(text) <= _PLAIN and self.alone.issuperset(text):
            # Every position ends a piece; the automaton names the longest first.
            best, count = [0.0] + [_NEVER] * len(text), [0] * (len(text) + 1)
            for end, (length, score) in self.automaton.iter(text):
                start, end = end + 1 - length, end + 1
                if best[start] + score > best[end]:
                    best[end], count[end] = best[start] + score, count[start] + 1
            return count[-1]
        ring = self.longest + 1
        best, count, lost = [0.0] * ring, [0] * ring, [False] * ring
        for end, pieces in self._ends(text):
            top = None
            for length, score in pieces:
                start = (end - length) % ring
                if top is None or best[start] + score > top:
                    top, number, gone = best[start] + score, count[start] + 1, False
            char = text[end - 1]
            if char not in self.alone:
                start = (end - 1) % ring
                if top is None or best[start] + self.unknown > top:
                    top, gone = best[start] + self.unknown, True
                    if self.bytes:
                        number = count[start] + len(char.encode("utf-8", "surrogatepass"))
                    else:
                        number = count[start] + (not lost[start])
            best[end % ring], count[end % ring], lost[end % ring] = top, number, gone
        return count[len(text) % ring]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) > 1 << 20:
            return sum(self[m[0]] for m in self.part.finditer(text))
        return sum(map(self.__getitem__, self.part.findall(text)))


_counters: dict[int, Counter] = {}


def _counter(pieces: list[tuple[str, float]]) -> Counter:
    mark = hash(tuple(pieces))
    if mark not in _counters:
        _counters.clear()
        _counters[mark] = Counter(pieces)
    return _counters[mark]


def counter(pieces: list[tuple[str, float]]):
    """A function of a column of texts that gives their numbers of tokens."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _counter(pieces)
        for batch in texts:
            yield batch.map(known.count).astype("int64")

    return count


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    return docs.select(F.col(key).alias(key), counter(load(model))(F.coalesce(F.col(text), F.lit(""))).alias("n_tokens"))
