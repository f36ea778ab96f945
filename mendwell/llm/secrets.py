"""Secrets in texts, found through a trigram index.

Each rule is a regular expression, and from it alone its Boolean trigram query is derived (``trigram_query``): all of
some clauses, of each clause one string or more, of each string all trigrams, letters in lower case. The index holds, for each
text, which trigrams of the queries it has; where the postings of a query meet, a text may match, and
only these texts are searched with the expression. A rule without a mandatory trigram is
searched for in every text.

Everything is DataFrame functions. Positions count code points; they come from the lengths
of the matches and of what lies between them. Texts of equal hash share postings, so
copies are indexed once, and a chance meeting of two hashes costs a search
in vain, not a wrong result. Null texts count as empty; repeated rows each get
their row; very long texts are searched whole; an empty table gives an empty result. Other
columns may have any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.session import cut_lineage, small_side

MOST_STRINGS = 64  # of one clause


class Unreadable(ValueError):
    """The expression has a part that this reader does not know."""


Clause = frozenset[str]


@dataclass(frozen=True)
class _Part:
    """Of a part of an expression: all strings it matches, if they are few, and clauses that hold for every match."""

    exact: frozenset[str] | None
    clauses: tuple[Clause, ...] = ()


def _clause(strings: frozenset[str]) -> tuple[Clause, ...]:
    """One of the strings; none if one of them has no trigram. A string that holds another one adds nothing."""
    if any(len(s) < 3 for s in strings):
        return ()
    return (frozenset(s for s in strings if not any(o != s and o in s for o in strings)),)


def _known(part: _Part) -> tuple[Clause, ...]:
    return part.clauses if part.exact is None else _clause(part.exact)


def _in_a_row(parts: list[_Part]) -> _Part:
    run, clauses, whole = frozenset([""]), [], True
    for part in parts:
        if part.exact is not None and len(run) * len(part.exact) <= MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, part.exact))
            continue
        clauses += _clause(run)
        clauses += part.clauses
        run, whole = part.exact or frozenset([""]), False
    return _Part(run) if whole else _Part(None, (*clauses, *_clause(run)))


def _one_of(parts: list[_Part]) -> _Part:
    if len(parts) == 1:
        return parts[0]
    if all(part.exact is not None for part in parts):
        union = frozenset().union(*(part.exact for part in parts))
        if len(union) <= MOST_STRINGS:
            return _Part(union)
    known = [_known(part) for part in parts]
    if not all(known):
        return _Part(None)
    best = (max(own, key=lambda c: (min(map(len, c)), -len(c))) for own in known)
    return _Part(None, _clause(frozenset().union(*best)))


def _repeated(part: _Part, least: int, most: int | None) -> _Part:
    if part.exact is not None and most is not None and most <= 8:
        made = _one_of([_in_a_row([part] * n) for n in range(least, most + 1)])
        if made.exact is not None:
            return made
    if not least:
        return _Part(None)
    row = _in_a_row([part] * min(least, 8))
    return _Part(None, _known(row))


class _Reader:
    """Literals, classes, groups, alternatives and repetitions of a regular expression."""

    _COUNT = re.compile(r"\{(\d+)(,?)(\d*)\}")

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def next(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        if not self.next():
            raise Unreadable(self.text)
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> _Part:
        found = [self.sequence()]
        while self.next() == "|":
            self.take()
            found.append(self.sequence())
        return _one_of(found)

    def sequence(self) -> _Part:
        parts = []
        while self.next() and self.next() not in "|)":
            parts.append(self.counted(self.atom()))
        return _in_a_row(parts)

    def counted(self, part: _Part) -> _Part:
        while self.next() and self.next() in "*+?{":
            sign = self.take()
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1), "{": (0, 0)}[sign]
            if sign == "{":
                found = self._COUNT.match(self.text, self.at - 1)
                if not found:
                    raise Unreadable(self.text)
                self.at = found.end()
                least = int(found[1])
                most = (int(found[3]) if found[3] else None) if found[2] else least
            if self.next() and self.next() in "?+":  # how it searches, not what it finds
                self.take()
            part = _repeated(part, least, most)
        return part

    def atom(self) -> _Part:
        sign = self.take()
        if sign == "(":
            return self.group()
        if sign == "[":
            return self.one_of_class()
        if sign == "\\":
            letters = self.escaped()
            return _Part(None if letters is None else frozenset(letters))
        if sign in "^$":
            return _Part(frozenset([""]))
        return _Part(None) if sign == "." else _Part(frozenset([sign.lower()]))

    def group(self) -> _Part:
        ahead = False
        if self.next() == "?":
            self.take()
            kind = self.take()
            if kind not in ":=!":
                raise Unreadable(self.text)
            ahead = kind in "=!"
        inner = self.alternatives()
        if self.take() != ")":
            raise Unreadable(self.text)
        return _Part(frozenset([""])) if ahead else inner  # what lies ahead is no part of the match

    def escaped(self) -> set[str] | None:
        """What an escape stands for; None for many characters."""
        sign = self.take()
        if sign == "x":
            return {chr(int(self.take() + self.take(), 16)).lower()}
        if sign in "bBAzZ":
            return {""}
        if sign in "dDwWsS":
            return None
        if sign in "nrtf":
            return {{"n": "\n", "r": "\r", "t": "\t", "f": "\f"}[sign]}
        if sign.isalnum():
            raise Unreadable(self.text)
        return {sign}

    def one_of_class(self) -> _Part:
        letters, many = set(), False
        if self.next() == "^":
            self.take()
            many = True
        first = True
        while first or self.next() != "]":
            first, sign = False, self.take()
            own = {sign.lower()} if sign != "\\" else self.escaped()
            if sign == "[" or own == {""}:
                raise Unreadable(self.text)
            if self.next() == "-" and self.text[self.at + 1:self.at + 2] != "]":
                self.take()
                last = self.take()
                if last in "\\[" or sign == "\\":
                    raise Unreadable(self.text)
                own = {chr(c).lower() for c in range(ord(sign), ord(last) + 1)} if ord(last) - ord(sign) < 128 else None
            many |= own is None
            letters |= own or set()
        self.take()
        return _Part(None if many or len(letters) > MOST_STRINGS else frozenset(letters))


def trigram_query(pattern: str) -> tuple[Clause, ...]:
    """Clauses that the lower-cased text of every match satisfies; none for an expression without mandatory trigrams, or
    with a part that ``_Reader`` does not know."""
    reader = _Reader(pattern)
    try:
        found = reader.alternatives()
        return tuple(dict.fromkeys(_known(found))) if reader.at == len(pattern) else ()
    except Unreadable:
        return ()


@dataclass(frozen=True)
class Rule:
    """``pattern`` has no capturing group unless ``group`` names the one whose length must reach ``least``."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0

    @cached_property
    def query(self) -> tuple[Clause, ...]:
        return trigram_query(self.pattern)


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])

# The rules asked for, in their order.
BASE = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def trigrams(string: str) -> tuple[str, ...]:
    return tuple(sorted({string[i:i + 3] for i in range(len(string) - 2)}))


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, rule's place, end) of the matches that count."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.zip_with(between, whole, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"))), counted,
        lambda s, c: F.struct(s.gap.alias("gap"), s["size"].alias("size"), (F.length(c) >= rule.least).alias("good")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def go(done: Column, step: Column) -> Column:
        begin = done["at"] + step["gap"]
        end = begin + F.coalesce(step["size"], F.lit(0))
        more = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(step["good"], F.concat(done["found"], more)).otherwise(done["found"]).alias("found"))

    return F.when(F.size(whole) > 0, F.aggregate(steps, start, go, lambda done: done["found"])).otherwise(
        F.array().cast("array<struct<start:int,end:int>>"))


def postings(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """The index: ``hash`` of a text and one ``trigram`` that it has, of those in the rules' queries."""
    wanted = sorted({t for rule in rules for clause in rule.query for s in clause for t in trigrams(s)})
    low = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.lower(F.col(text)).alias("low"))
    found = F.array_compact(F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in wanted)))
    return low.select("hash", F.explode(found).alias("trigram"))


def _holds(have: Column, rule: Rule) -> Column:
    """Whether a set of trigrams satisfies the query of the rule."""
    def string(s: str) -> Column:
        own = trigrams(s)
        return F.size(F.array_intersect(have, F.array(*map(F.lit, own)))) == len(own)

    clauses = [reduce(lambda a, b: a | b, [string(s) for s in sorted(clause)]) for clause in rule.query]
    return reduce(lambda a, b: a & b, clauses)


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``hash`` and ``kinds``, the rules whose queries its postings satisfy."""
    met = index.groupBy("hash").agg(F.collect_set("trigram").alias("have"))  # no more than all rules ask for
    kinds = [F.when(_holds(F.col("have"), rule), F.lit(rule.kind)) for rule in rules if rule.query]
    return met.select("hash", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, and one array of (start, end) for each rule, named as its kind."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # hashes only; while they are few, the texts stay where they are
    found = rows.join(small_side(cut_lineage(candidates(postings(docs, rules, text), rules))), "hash", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return found.select("key", *(
        (F.when(F.array_contains("kinds", rule.kind), _spans(F.col("text"), rule)).otherwise(none)
         if rule.query else _spans(F.col("text"), rule)).alias(rule.kind) for rule in rules))


def _listed(rules: tuple[Rule, ...]) -> Column:
    """All spans as text, by start and the order of the rules."""
    def with_kind(place: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    every = F.concat(*(with_kind(i, rule.kind) for i, rule in enumerate(rules)))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", base: tuple[Rule, ...] = BASE,
           added: tuple[Rule, ...] = ADDED) -> DataFrame:
    found = scan(docs, base + added, text, key)
    return found.select(
        F.col("key").alias(key), *(F.size(rule.kind).cast("long").alias(f"n_{rule.kind}") for rule in base),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(base + added).alias("spans"))
