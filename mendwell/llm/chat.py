"""Conversations as windows of a token budget, with a loss mask and a template that can be read back.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts every ``<``, backslashes, ``|`` gets one
more backslash, so that ``<|`` is in the marks alone; taking that backslash away gives the text back. A window holds whole
turns: those of a span that begins where the span before has ended, before them a limited history that is repeated
from the span before, and ahead of all the system turn, if the conversation begins with one. Prefix sums of
token counts tell by binary search how far history and span reach. Only the texts of assistant turns in their own
span are under the loss mask; repeated ones are not, so each is a target once.

A turn beyond the whole budget has a window with no more than the system turn. A conversation is cut into chapters
by turn number, so that one that holds a large part of all turns is formatted by many tasks: a window ends with
its chapter, history comes from its own chapter or the one before. Rows of one turn number have one chapter, however many.

Null roles and texts become empty; turns are ordered by number, null first, and those of one number by the name of the
turn (a hash); repeated rows are turns of their own; rows without ``conv_id`` are one conversation. Very long texts are turns
like others. An empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.llm.conversations import named_turns
from mendwell.session import cut_lineage, small_side

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
SYSTEM, ASSISTANT = "system", "assistant"
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]"
MARK_TOKENS = 4  # of the marks and the role of a turn
BUDGET = 1024
HISTORY = 256
HISTORY_TURNS = 4
CHAPTER = 1024
OUT_ROWS = 256

WINDOWS = ("conv_id long, chapter long, window long, text string, repeated int, loss array<struct<start: int, stop: int>>,"
           " tokens long, whole boolean")
# texts that look like the marks of other templates
LOOKALIKE = r"\### Assistant: </turn> ok"

_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def spans(tokens: Sequence[int], known: int, room: int, history: int, most: int) -> Iterator[tuple[int, int, int]]:
    """Spans ``start`` to ``stop`` of turns, and where the history repeated before them begins; the ``known`` first turns are in
    earlier spans."""
    sums = np.concatenate([[0], np.cumsum(np.asarray(tokens, np.int64))])
    start, total = known, len(sums) - 1
    while start < total:
        first = max(start - most, int(np.searchsorted(sums, sums[start] - history)), 0)
        first = max(first, min(start, int(np.searchsorted(sums, sums[start + 1] - room))))
        stop = max(start + 1, int(np.searchsorted(sums, sums[first] + room, "right")) - 1)
        yield first, start, stop
        start = stop


def _pieces(turns: DataFrame) -> DataFrame:
    """Turns as the template writes them, the place of the text in them, their tokens and their chapter."""
    role, text = escape(F.col("role")), escape(F.col("text"))
    return named_turns(turns).select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / CHAPTER), F.lit(-(1 << 62))).alias("chapter"), "turn", F.unhex("name").alias("name"),
        F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END)).alias("piece"), F.char_length(role).alias("role_size"),
        (F.col("role") == SYSTEM).alias("system"), (F.col("role") == ASSISTANT).alias("target"),
        (F.regexp_count("text", F.lit(TOKEN)) + MARK_TOKENS).cast("long").alias("tokens"))


def _with_chapters(pieces: DataFrame, turns: DataFrame, most: int) -> DataFrame:
    """Adds ``kind`` (0: system turn of an earlier chapter, 1: history from the chapter before, 2: a turn of the chapter),
    ``later`` (not the first chapter) and ``whole`` (the only chapter)."""
    chapter = F.coalesce(F.floor(F.col("turn") / CHAPTER), F.lit(-(1 << 62))).alias("chapter")
    order = Window.partitionBy("conv").orderBy("chapter")
    many = turns.select(F.col("conv_id").alias("conv"), chapter).distinct().select(
        "conv", F.col("chapter").alias("of"), F.lead("chapter").over(order).alias("next"), F.lag("chapter").over(order).isNotNull().alias("later"),
    ).filter(F.col("next").isNotNull() | F.col("later"))
    many = cut_lineage(many)  # chapters of conversations that have more than one
    here = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("chapter") == F.col("of"))
    plain = [F.col(c) for c in pieces.columns]
    own = pieces.join(small_side(many), here, "left").select(
        *plain, F.lit(2).alias("kind"), F.coalesce("later", F.lit(False)).alias("later"), F.col("of").isNull().alias("whole"), "next")
    base = own.drop("next")
    if many.isEmpty():
        return base
    parts = cut_lineage(own.filter(~F.col("whole")))
    tail = Window.partitionBy("conv_id", "chapter").orderBy(F.desc_nulls_last("turn"), F.desc("name"))
    head = Window.partitionBy("conv_id", "chapter").orderBy(F.asc_nulls_first("turn"), "name")
    opens = F.col("system") & ~F.col("later") & (F.row_number().over(head) == 1)  # the system turn is retained, not history
    history = parts.filter(F.col("next").isNotNull()).withColumns({"_back": F.row_number().over(tail), "_opens": opens}).filter(
        (F.col("_back") <= most) & ~F.col("_opens"))
    history = history.withColumns({"chapter": F.col("next"), "kind": F.lit(1), "later": F.lit(True)}).select(*base.columns)
    first = parts.filter(~F.col("later")).groupBy("conv_id").agg(F.min_by(F.struct(*base.columns), F.struct("turn", "name")).alias("t"))
    system = first.filter("t.system").select("t.*").alias("s").join(
        many.filter("later").select("conv", "of"), F.col("s.conv_id").eqNullSafe(F.col("conv")))
    system = system.withColumns({"chapter": F.col("of"), "kind": F.lit(0), "later": F.lit(True)}).select(*base.columns)
    return base.filter("whole").unionByName(parts.select(*base.columns)).unionByName(history).unionByName(system)


class Chapter:
    """Turns of a chapter as they come, in the order of the conversation."""

    def __init__(self, conv, chapter: int, later: bool, whole: bool, rules: tuple[int, int, int]):
        self.conv, self.chapter, self.later, self.whole, self.rules = conv, chapter, later, whole, rules
        self.system, self.told = None, False
        self.turns: list = []
        self.known = self.number = 0

    def add(self, row) -> None:
        if row.kind == 0 or (row.kind == 2 and row.system and not self.later and not self.turns and self.system is None):
            self.system, self.told = row, row.kind == 0
        else:
            self.known += row.kind == 1
            self.turns.append(row)

    def _window(self, rows: list, repeated: int) -> dict:
        if self.system is not None:
            rows, repeated = [self.system, *rows], repeated + self.told
            self.told = True
        loss, at = [], 0
        for place, row in enumerate(rows):
            start = at + len(TURN) + row.role_size + len(TEXT)
            at += len(row.piece)
            if row.target and place >= repeated:
                loss.append({"start": start, "stop": at - len(END)})
        self.number += 1
        return {"conv_id": self.conv, "chapter": self.chapter, "window": self.number - 1, "text": "".join(r.piece for r in rows),
                "repeated": repeated, "loss": loss, "tokens": sum(r.tokens for r in rows), "whole": self.whole}

    def windows(self, last: bool) -> Iterator[dict]:
        budget, history, most = self.rules
        room = budget - (self.system.tokens if self.system is not None else 0)
        for first, start, stop in spans([row.tokens for row in self.turns], self.known, room, history, most):
            yield self._window(self.turns[first:stop], start - first)
        if last and not self.number and self.system is not None:
            yield self._window([], 0)
        self.turns = self.turns[-most:] if most else []
        self.known = len(self.turns)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, most: int = HISTORY_TURNS) -> DataFrame:
    """Windows of all conversations: ``conv_id``, ``chapter``, ``window`` (from 0 in its chapter), ``text``, ``repeated`` (turns at
    its beginning that earlier windows have), ``loss`` (places in ``text`` under the mask, code points, end exclusive),
    ``tokens``, ``whole`` (the chapter is the whole conversation)."""
    rows = _with_chapters(_pieces(turns), turns, most).repartition("conv_id", "chapter").sortWithinPartitions(
        "conv_id", "chapter", "kind", "turn", "name")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chapter, out = None, []
        for batch in batches:
            convs = batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None)
            for conv, row in zip(convs, batch.itertuples(index=False)):
                if chapter is None or (chapter.conv, chapter.chapter) != (conv, row.chapter):
                    out += chapter.windows(True) if chapter else []
                    chapter = Chapter(conv, row.chapter, row.later, row.whole, (budget, history, most))
                elif len(chapter.turns) >= 2 * CHAPTER:  # very many rows of one number: what is there is formatted, its end goes on as history
                    out += chapter.windows(False)
                chapter.add(row)
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out)
                    out = []
        out += chapter.windows(True) if chapter else []
        if out:
            yield pd.DataFrame(out)

    columns = "conv_id, chapter, kind, later, whole, piece, role_size, system, target, tokens".split(", ")
    return rows.select(*columns).mapInPandas(work, WINDOWS)


def read_window(text: str, repeated: int) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a window that no earlier one has."""
    turns = [piece[:-len(END)].split(TEXT) for piece in text.split(TURN)[1:]]
    return [(unescape(role), unescape(body)) for role, body in turns[repeated:]]


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``,
    ``formatted_chars``. ``windows`` comes from ``format_windows``, chapters together and in order.

    A conversation of one chapter is read where it was written; chapters of others are read side by side and meet as
    a stream of texts, of which a task holds one at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    class Digest:
        def __init__(self, key):
            self.key, self.turns, self.loss = key, hashlib.sha256(), hashlib.sha256()
            self.n_turns = self.loss_chars = self.chars = 0

        def add(self, n_turns: int, turns: str, loss: str, chars: int) -> None:
            self.turns.update(turns.encode())
            self.loss.update(loss.encode())
            self.n_turns, self.loss_chars, self.chars = self.n_turns + n_turns, self.loss_chars + len(loss), self.chars + chars

        def row(self) -> tuple:
            return self.key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, columns = None, ["chapter", "window", *names, "done"]
        for batch in batches:
            out = []
            convs = batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None)
            for conv, row in zip(convs, batch.itertuples(index=False)):
                turns = read_window(row.text, row.repeated)
                said = (len(turns), "".join(f"{role}\n{text}\n" for role, text in turns),
                        "".join(unescape(row.text[place["start"]:place["stop"]]) for place in row.loss), len(row.text))
                if row.whole:
                    if held is None or held.key != conv:
                        out += [(0, 0, *held.row(), True)] if held else []
                        held = Digest(conv)
                    held.add(*said)
                else:
                    out.append((row.chapter, row.window, conv, said[0], said[1], 0, said[2], said[3], False))
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(0, 0, *held.row(), True)], columns=columns)

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            convs = batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None)
            for conv, row in zip(convs, batch.itertuples(index=False)):
                if held and (row.done or held.key != conv):
                    out.append(held.row())
                    held = None
                if row.done:
                    out.append((conv, row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256, row.formatted_chars))
                else:
                    held = held or Digest(conv)
                    held.add(row.n_turns, row.turns_sha256, row.loss_sha256, row.formatted_chars)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([held.row()], columns=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read = windows.mapInPandas(parts, f"chapter long, window long, {schema}, done boolean")
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "chapter", "window").mapInPandas(joined, schema)


def with_lookalikes(turns: DataFrame) -> DataFrame:
    """The turns and those of a conversation -7, whose texts look like marks."""
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = [(-7, 0, "user", LOOKALIKE), (-7, 1, ASSISTANT, LOOKALIKE)]
    return own.unionByName(turns.sparkSession.createDataFrame(rows, own.schema))


def report(turns: DataFrame) -> DataFrame:
    """``read_back`` of the windows of all conversations and of -7."""
    return read_back(format_windows(with_lookalikes(turns)))
