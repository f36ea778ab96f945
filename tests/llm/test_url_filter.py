from collections import defaultdict

import pytest

from mendwell.llm import url_filter


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    path = rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, path[:min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(pages, marks):
    """(key, host, path, rule, verdict, template), by a walk over each host's tree."""
    rows = [[k, *parse(u)] for k, u in pages]
    template = [r[2].split("/")[0] for r in rows]
    parts = [r[2].split("/") for r in rows]
    bad = [marks.get(r[0]) for r in rows]
    for depth in range(1, min(max(map(len, parts)), url_filter.MAX_DEPTH)):
        node, seen = defaultdict(list), defaultdict(list)
        for i, p in enumerate(parts):
            if len(p) > depth:
                node[rows[i][1], template[i]].append(i)
                seen[rows[i][1], template[i], p[depth]].append(i)
        new = list(template)
        for (host, t, part), inside in seen.items():
            below = node[host, t]
            known = [bad[i] for i in below if bad[i] is not None]
            share = (sum(known) + 1) / (len(known) + 2)
            own = [bad[i] for i in inside if bad[i] is not None]
            often = len(inside) >= url_filter.MIN_ROWS and len(inside) >= url_filter.MIN_SHARE * len(below)
            apart = abs(sum(own) - share * len(own)) > url_filter.SIGMAS * (share * (1 - share) * len(own)) ** 0.5
            for i in inside:
                new[i] = t + "/" + ("" if part == "" else part if often and apart else "*")
        template = new
    template = [t + "/**" if len(p) > url_filter.MAX_DEPTH else t for t, p in zip(template, parts)]
    every = [b for b in bad if b is not None]
    overall = (sum(every) + 1) / (len(every) + 2)

    def smooth(chosen, prior):
        known = [bad[i] for i in chosen if bad[i] is not None]
        return (sum(known) + url_filter.SMOOTHING * prior) / (len(known) + url_filter.SMOOTHING)

    hosts, leaves = defaultdict(list), defaultdict(list)
    for i, r in enumerate(rows):
        hosts[r[1]].append(i)
        leaves[r[1], template[i]].append(i)
    out = []
    for i, (key, host, path) in enumerate(rows):
        share = smooth(leaves[host, template[i]], smooth(hosts[host], overall))
        name, verdict = rule(host, path)
        out.append((key, host, path, name, verdict or ("block" if share >= url_filter.LIMIT else "allow"), template[i], round(share, 9)))
    return sorted(out, key=repr)


def found(spark, pages, marks):
    df = spark.createDataFrame([(*p, 1, "h") for p in pages], "page_id long, url string, `all` int, host string")
    known = spark.createDataFrame(list(marks.items()), "page_id long, bad double")
    got = url_filter.report(df, known)
    return sorted(((*tuple(r)[:6], round(r.share, 9)) for r in got.collect()), key=repr)


URLS = [
    None, "", "no scheme", "http://", "HTTP://ÄB.Example.ORG/es/1", "http://example.org", "http://example.org/en/1x", "http://example.org/en/2",
    "http://aexample.org/es/", "http://x.example.org/es/?a", "https://a.com/fr/1", "https://com/de/", "https://a.com/de", "https://a.net/a//b/",
    "x://y://z/1", "http://h.net/" + "/".join("abcdefghijklmnopq"), "http://h.net/a/b#c?d", "http://h?x=/y", "http://org", "http://a.org/", "\n://a.org/\n",
]


def test_rules_and_odd_urls(spark):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, "http://a.com/fr/9"), (None, None)]
    marks = {5: 1.0, 7: 0.0, 10: None}
    assert found(spark, pages, marks) == brute(pages, {k: v for k, v in marks.items() if v is not None})


@pytest.mark.parametrize("seed", [1, 2])
def test_a_tree(spark, seed):
    import random

    draw = random.Random(seed)
    pages, marks = [], {}
    for i in range(900):
        branch = draw.choice(["spam", "news", "blog", f"x{i}"])
        pages.append((i, f"http://h{draw.randint(0, 1)}.net/{branch}/{draw.choice(['a', 'b', str(i)])}/{i}.html"))
        if draw.random() < 0.6:
            marks[i] = float(draw.random() < (0.9 if branch == "spam" else 0.1))
    got = found(spark, pages, marks)
    assert got == brute(pages, marks)
    assert {(r[4], r[2].split("/")[1]) for r in got if r[2].split("/")[1] in ("spam", "news")} == {("block", "spam"), ("allow", "news")}
    assert {"spam", "*"} <= {r[5].split("/")[1] for r in got} <= {"spam", "news", "blog", "*"}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.report(df, spark.createDataFrame([], "page_id long, bad double")).count() == 0


def test_the_query(spark, tiny):
    pages, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("pages", "labels"))
    got = url_filter.report(pages, url_filter.document_marks(pages, labels)).collect()
    bad = {r.doc_id: float(r.quality == 0 or r.toxic == 1) for r in labels.collect()}
    rows = [(r.page_id, r.url) for r in pages.collect()]
    number = {k: int("".join(filter(str.isdigit, parse(u)[1].split("/")[2]))) for k, u in rows}
    want = brute(rows, {k: bad[n] for k, n in number.items() if n in bad})
    assert sorted(((*tuple(r)[:6], round(r.share, 9)) for r in got), key=repr) == want


def test_a_small_section_of_a_large_host(spark):
    pages = [(i, f"http://h.net/s{i // 30}/{i}" if i < 3000 else f"http://h.net/bad/{i}") for i in range(3030)]
    marks = {k: float(u.startswith("http://h.net/bad/")) for k, u in pages}
    got = found(spark, pages, marks)
    assert got == brute(pages, marks)
    assert {(r[4], r[5].split("/")[1]) for r in got} == {("block", "bad"), ("allow", "*")}


def test_templates_that_differ_far_below(spark):
    deep = "/".join("abcdefghijklmnopqrst")
    pages = [(i, f"http://h.net/{deep}/{('bad', 'good')[i % 2]}//{i}/x") for i in range(80)] + [(80, f"http://h.net/{deep}/{deep}/{deep}/")]
    marks = {k: float(k % 2 == 0) for k, _ in pages[:80]}
    got = found(spark, pages, marks)
    assert got == brute(pages, marks)
    assert {(r[4], r[5]) for r in got if r[0] < 80} == {(v, "/*" * 20 + f"/{s}//*/*") for v, s in (("block", "bad"), ("allow", "good"))}
    assert {r[5] for r in got if r[0] == 80} == {"/*" * 60 + "/"}
