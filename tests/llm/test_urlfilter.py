from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from classmeter.llm import urlfilter
from classmeter.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG", "https://example.org/es/x", "http://a.example.org/en/17", "http://a.example.org/en/27",
    "https://notexample.org/es/", "ftp://x.com/fr/a?b=1#c", "http://x.com/fr", "http://x.com/de/9", "http://com/de/", "http://org", "http://org/",
    "http://ÄB.Com/de/é?x", "http://x.org:80/es/", "a://b://c/d", "http://x.net?u=/org/", "http://x.net#/es/", "http://u@example.org/es/\nq", "://org/a",
]


def plain(url):
    """host, path, and rule with verdict, by the contract."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = []
    for verdict, rule in URL_RULES:
        name, _, begin = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + begin):
            fits.append((len(rule), verdict == "block", rule, verdict))
    return host, path, max(fits)[2:] if fits else None


def frame(spark, urls):
    rows = [(i, u, "x", "y", "z", "w") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, path string, tokens string, verdict string")


def plain_mined(labelled, others, support, confidence):
    """Verdicts by listing all token combinations of the labelled sets."""
    whole, blocked = Counter(), Counter()
    for tokens, verdict in labelled:
        for n in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), n):
                whole[some] += 1
                blocked[some, verdict] += 1
    least = -(-support * len(labelled) // 1)
    rules = [(n / whole[some], n / len(labelled), len(some), verdict == "block", set(some)) for (some, verdict), n in blocked.items() if n >= least and n / whole[some] >= confidence]
    out = []
    for tokens in others:
        fired = [r[:4] for r in rules if r[4] <= set(tokens)]
        out.append(("block" if max(fired)[3] else "allow") if fired else None)
    return out


def test_parts_and_rules(spark):
    rows = urlfilter.judge(frame(spark, URLS), URL_RULES, min_support=1.0).orderBy("page_id").collect()
    for r, url in zip(rows, URLS, strict=True):
        host, path, found = plain(url)
        assert (r.host, r.path) == (host, path), url
        assert (r.rule, r.verdict) == (found or (None, "allow")), url


def test_the_longest_rule_wins(spark):
    rules = [("allow", "b.c/"), ("block", "c/xy"), ("block", "b.c/x"), ("allow", "a.b.c/")]
    urls = ["q://a.b.c/x", "q://b.c/xy", "q://c/xy", "q://z.b.c/", "q://d/"]
    rows = frame(spark, urls).select(urlfilter.explicit(urlfilter.host(F.col("url")), urlfilter.path(F.col("url")), rules).alias("r")).collect()
    assert [r.r and r.r.rule for r in rows] == ["a.b.c/", "b.c/x", "c/xy", "b.c/", None]


@pytest.mark.parametrize("support, confidence", [(0.005, 0.8), (0.05, 0.95), (0.02, 0.6)])
def test_mined_rules_against_all_combinations(spark, support, confidence):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("page_id", "url", urlfilter.tokens(F.col("url")).alias("tokens")).orderBy("page_id").collect()
    known = [(r.tokens, plain(r.url)[2][1]) for r in rows if plain(r.url)[2]]
    rest = [r for r in rows if not plain(r.url)[2]]
    expected = plain_mined(known, [r.tokens for r in rest], support, confidence)
    found = {r.page_id: r for r in urlfilter.judge(pages, URL_RULES, min_support=support, min_confidence=confidence).collect()}
    assert len(found) == len(rows)
    assert [found[r.page_id].verdict for r in rest] == [e or "allow" for e in expected]
    assert "block" in expected
    assert all((found[r.page_id].rule, found[r.page_id].verdict) == plain(r.url)[2] for r in rows if plain(r.url)[2])


def test_tokens(spark):
    row = frame(spark, ["https://www.big-win.example.com/en/a12/b7.html?q=1&ref=x#top"]).select(urlfilter.tokens(F.col("url")).alias("t")).first()
    assert row.t == sorted([
        "scheme:https", "tld:com", "domain:example.com", "word:www", "word:big", "word:win", "first:en", "shape:a0", "shape:b0", "ext:html", "query:q", "query:ref", "anchor",
    ])


def test_edges(spark):
    assert urlfilter.judge(frame(spark, []), URL_RULES).collect() == []
    only = urlfilter.judge(frame(spark, [None, "", "http://x.net/"]), URL_RULES).collect()
    assert {(r.rule, r.verdict) for r in only} == {(None, "allow")}
    twice = urlfilter.judge(frame(spark, ["http://x.org/"]).union(frame(spark, ["http://x.org/"])), URL_RULES)
    assert [tuple(r) for r in twice.collect()] == [(0, "x.org", "/", "org/", "allow")] * 2


def test_no_python_in_the_plan(spark):
    plan = urlfilter.judge(frame(spark, URLS), URL_RULES)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_deep_segments_are_tokens(spark):
    """What tells URLs apart may lie deep in the path, in the labelled ones and in the others."""
    rules = [("block", "bad.com/"), ("allow", "good.com/")]
    urls = [f"http://bad.com/a/b/c/d/e/f/casino{i}" for i in range(20)] + [f"http://good.com/a/b/c/d/e/f/news{i}" for i in range(20)]
    others = ["http://x.net/q/w/r/t/y/u/casino77", "http://x.net/q/w/r/t/y/u/news77", "http://x.net/casino7"]
    rows = urlfilter.judge(frame(spark, urls + others), rules).orderBy("page_id").collect()
    assert [r.verdict for r in rows] == ["block"] * 20 + ["allow"] * 20 + ["block", "allow", "allow"]
    found = frame(spark, ["q://h/1/2/3/4/5/6/x7y.z", "q://h", "q://h/1"]).select(urlfilter.tokens(F.col("url")).alias("t")).collect()
    assert "shape:x0y" in found[0].t and not any(t.startswith("shape:") for r in found[1:] for t in r.t)
