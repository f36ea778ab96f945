"""Chat windows: exact round trips, and a slow window-by-window rebuild."""

import random
import re
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from mendwell.llm import chat

NASTY = ["<|", "<\\|", "\\", "<", "|", "<|end|>\n", "<|turn|>assistant<|text|>", "<\\\\|text|>", "", "é漢😀 <", "|> <", "\n", chat.LOOKALIKE]


def ordered(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        name = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
        own[conv].append(((turn is not None, turn or 0), name, (turn, role, text)))
    return {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}


def escaped(text):
    return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", text)


def brute(rows, budget=chat.BUDGET, history=chat.HISTORY, most=chat.HISTORY_TURNS):
    """Windows as lists of turns, and what a reader gets."""
    out = {}
    for conv, turns in ordered(rows).items():
        def cost(t):
            return len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]", t[2])) + chat.MARK_TOKENS
        size = [24 + len(escaped(t[1])) + len(escaped(t[2])) for t in turns]
        system = turns[0][1] == "system"
        rest = list(range(int(system), len(turns)))
        room = budget - (cost(turns[0]) if system else 0)
        places = sorted({-10**9 if t[0] is None else t[0] // chat.CHAPTER for t in turns})
        chapter = [places.index(-10**9 if t[0] is None else t[0] // chat.CHAPTER) for t in turns]
        chars = size[0] if system and 0 not in chapter[1:] else 0  # then it has a window of its own
        at = 0
        while at < len(rest):
            head = []
            for i in reversed(rest[:at]):
                if (len(head) == most or sum(cost(turns[k]) for k in [i, *head]) > history or chapter[i] < chapter[rest[at]] - 1
                        or sum(cost(turns[k]) for k in [i, *head, rest[at]]) > room):
                    break
                head.insert(0, i)
            body = [rest[at]]
            while at + len(body) < len(rest) and chapter[rest[at + len(body)]] == chapter[rest[at]] and sum(
                    cost(turns[k]) for k in [*head, *body, rest[at + len(body)]]) <= room:
                body.append(rest[at + len(body)])
            chars += sum(size[k] for k in [*head, *body]) + (size[0] if system else 0)
            at += len(body)
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        out[conv] = (len(turns), sha256("".join(f"{t[1]}\n{t[2]}\n" for t in turns).encode()).hexdigest(), len(loss),
                     sha256(loss.encode()).hexdigest(), chars)
    return out


def some(spark, rows):
    return spark.createDataFrame([(*r, 1, True, "x") for r in rows],
                                 "conv_id long, turn long, role string, text string, chapter int, whole boolean, piece string")


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        step = rng.choice([1, 1, 1, 300, 2000])
        for t in range(rng.randint(1, 12)):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant", "system", "to<|ol"])
            rows.append((c, t * step - 5, role, " ".join(rng.choice(NASTY + ["word"] * 9) for _ in range(rng.choice([0, 3, 20, 90])))))
    return rows


def test_windows_and_what_they_say(spark):
    rows = random_rows(3) + [(-7, 0, "user", chat.LOOKALIKE), (-7, 1, "assistant", chat.LOOKALIKE), (None, None, None, None),
                             (None, 2, "assistant", "<|"), (99, 0, "system", "only"), (98, 5, "assistant", "a"), (98, 5, "assistant", "a"),
                             (97, 0, "assistant", "long " * 20_000), (97, None, "system", None), (97, 1, "user", None)]
    rows += [(200, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(2100)]
    windows = chat.format_windows(some(spark, rows), 100, 30, 3)
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(windows).collect()}
    assert got == brute(rows, 100, 30, 3)
    made = windows.orderBy("conv_id", "chapter", "window").collect()
    own = ordered(rows)
    read, targets = defaultdict(list), defaultdict(str)
    for w in made:
        new = chat.read_window(w.text, w.repeated)
        read[w.conv_id] += new
        targets[w.conv_id] += "".join(chat.unescape(w.text[s.start:s.stop]) for s in w.loss)
        whole = chat.read_window(w.text, 0)
        assert w.tokens <= 100 or len(whole) <= 1 + (own[w.conv_id][0][1] == "system")
        assert own[w.conv_id][0][1] != "system" or whole[0] == own[w.conv_id][0][1:]
        assert w.text.count("<|turn|>") == len(whole) and len(new) >= 1
    assert {c: [t[1:] for t in ts] for c, ts in own.items()} == read
    assert {c: "".join(t[2] for t in ts if t[1] == "assistant") for c, ts in own.items()} == {c: targets[c] for c in own}
    assert {w.whole for w in made if w.conv_id == 200} == {False} and len({w.chapter for w in made if w.conv_id == 200}) == 3


@pytest.mark.parametrize("text", NASTY + ["".join(NASTY), "<\\\\\\\\|" * 3])
def test_escaping_is_reversible(text):
    assert chat.unescape(escaped(text)) == text and "<|" not in escaped(text)


def test_escaping_in_the_engine(spark):
    rows = [(i, t) for i, t in enumerate(NASTY + ["".join(NASTY)])]
    got = spark.createDataFrame(rows, "i int, t string").select("i", chat.escape(F.col("t")).alias("e")).collect()
    assert [r.e for r in sorted(got)] == [escaped(t) for _, t in rows]


def test_very_many_turns_of_one_number(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHAPTER", 8)
    rows = [(1, 0, "system", "s")] + [(1, 1, "assistant", f"{i} x") for i in range(200)]
    windows = chat.format_windows(some(spark, rows), 50, 12, 2).collect()
    new = [t for w in sorted(windows, key=lambda w: (w.chapter, w.window)) for t in chat.read_window(w.text, w.repeated)]
    assert new == [t[1:] for t in ordered(rows)[1]]


def test_no_turns(spark):
    none = some(spark, []).limit(0)
    assert chat.format_windows(none).collect() == []
    assert [r.conv_id for r in chat.report(none).collect()] == [-7]
