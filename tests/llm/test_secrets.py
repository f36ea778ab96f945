import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies

from mendwell.llm import secrets

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text, base = text or "", []
    base += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = [(m.start(), 3, "github", m.end()) for m in re.finditer("gh[opsur]_[A-Za-z0-9]+", text) if len(m[0]) >= 40]
    more += [(m.start(), 4, "pem", m.end()) for m in re.finditer("-----BEGIN [A-Z ]*PRIVATE KEY-----", text)]
    listed = [",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(x)) for x in (base, base + more)]
    return (*(sum(s[1] == i for s in base) for i in range(3)), hashlib.sha256(listed[0].encode()).hexdigest(), listed[1])


TEXTS = [
    "password=abcdef", "PassWord\"  :  'abcdefg", "secret:token:abcdefgh", "token=abc token=abcdef", "token = token=abcdef1",
    "api_key=ABCDEF apikey='x/y+z=_.-' API_KEY:1234567", "passwordpassword=aaaaaa", "ſecret=abcdefg toKen=abcdefg",
    "AKIA" + "B" * 16, "AKIA" + "B" * 15, "AKIAxAKIA" + "9" * 30, "AKIAAKIA" + "1" * 13, "xAKIA" + "Z" * 40 + "a",
    "f" * 24, "F" * 24, "g" + "0" * 23 + "g" + "1" * 25, "😀 é token=漢abcdef 😀token=abcdef " + "ab12" * 9,
    "ghp_" + "a1" * 18, "ghp_" + "a" * 35, "-----BEGIN RSA PRIVATE KEY-----\nx\n-----BEGIN PRIVATE KEY-----", "",
    None, "token=abcdef " * 300, "secret:" + "a" * 100_000, "=token", "password\n=abcdef", "pas ass ssw swo wor ord pass word",
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return {r.doc_id: tuple(r)[1:] for r in secrets.report(df).collect()}


@pytest.mark.parametrize("at", range(len(TEXTS)))
def test_spans(found, at):
    assert found[at] == brute(TEXTS[at])


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = secrets.report(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in rows) == sorted(
        (k is None, k or 0, *brute(t)) for k, t, *_ in odd_rows)
    assert secrets.report(no_docs).count() == 0


def test_plan_has_no_python(odd_docs):
    plan = secrets.report(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


WORD = "[sS][eE][cC][rR][eE][tT]"
PATTERNS = {
    **{rule.pattern: bool(rule.query) for rule in secrets.BASE + secrets.ADDED}, "abc": True, "ab": False, "ab?cde": True, "(abc|abd)+x": True,
    "(abc|x)y": False, "(?:abc|defg)[0-9]*(?:hij)?": True, "a{3}": True, "a{2,}b": False, "(ab){2,3}": True, "[^a]bcd": True, "x*yyy.zzz$": True,
    "\\x41\\x4Bia": True, "[a-]b[]c]dddd": True, "foo\\.bar\\d+": True, "\\bkey(?=abc)": True, f"({WORD})(a|b)?=": True, "(a|bc|def)*ghi": True,
    "(one|two|three){1,2}[xyz]{2}": True, "a{0}bcd": True, "(?:)": False, "[a-z]{20}": False, "x{9}": True, "(?!abc)de": False,
}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_match_satisfies_the_derived_query(pattern):
    query = secrets.trigram_query(pattern)
    assert bool(query) == PATTERNS[pattern], query

    @settings(max_examples=150, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(strategies.from_regex(re.compile(pattern, re.ASCII), fullmatch=False))
    def holds(text):
        match = re.search(pattern, text, re.ASCII)
        low = match[0].lower() if match else ""
        assert not match or all(any(all(t in low for t in secrets.trigrams(s)) for s in clause) for clause in query)

    holds()


def test_derived_queries():
    assert secrets.BASE[0].query == (frozenset({"password", "passwd", "secret", "token", "apikey", "api_key"}),)
    assert secrets.BASE[1].query == (frozenset({"akia"}),) and secrets.BASE[2].query == ()
    assert secrets.ADDED[1].query == (frozenset({"-----begin "}), frozenset({"private key-----"}))
    for unknown in ("(?i)abcd", "(?<=x)abcd", "abc(", "a\\1bcd", "[[:alpha:]]abc", "abcd)"):
        assert secrets.trigram_query(unknown) == ()  # such a rule is searched for everywhere


def test_a_rule_of_the_users_own(spark):
    rule = secrets.Rule("own", "(?:card|iban)[0-9]{3}")
    texts = ["xx CARD123", "card12", "card123 iban456", "", "iban 123"]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (rule,)).collect()
    assert {r.key: [tuple(s) for s in r.own] for r in got} == {0: [], 1: [], 2: [(0, 7), (8, 15)], 3: [], 4: []}


def test_only_texts_with_all_trigrams_of_a_string_are_candidates(spark):
    df = spark.createDataFrame([(1, "tok oke only"), (2, "a ToKeN"), (3, "secre")], "doc_id long, text string")
    got = secrets.candidates(secrets.postings(df, secrets.BASE), secrets.BASE).collect()
    assert [list(r.kinds) for r in got] == [["assign"]]
    assert secrets.trigrams("token") == ("ken", "oke", "tok")
