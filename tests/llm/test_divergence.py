import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from classmeter.llm import divergence

SCHEMA = "lang string, source string, text string"


def brute(docs, min_docs, top):
    """The contract, group by group."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    rows = [(a or "", s or "", re.findall(divergence.TERM, low(t or ""))) for a, s, t in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        held = Counter(t for r in mine for t in set(r[2]))
        kept = {t for t in held if held[t] >= min_docs}

        def shares(of):
            n = Counter(t for r in of for t in r[2] if t in kept)
            return n, {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}

        q = shares(mine)[1]
        groups = {s: shares([r for r in mine if r[1] == s]) for s in {r[1] for r in mine}}
        for s, (n, p) in groups.items():
            pairs = sorted((-sum(abs(p[t] - groups[o][1][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[t] - p[t], t.encode()) for t in kept if n[t] and p[t] > q[t])[:top]
            for part, listed in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, o.decode(), -v, i) for i, (v, o) in enumerate(listed, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = ["Ab", "b", "c", "dé", "\U0001f600x", "e1f", "g", "AÉ", "x_y"]
    texts = [None, "", *(" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(6))]
    sources = [None, "", "a", "b", "c", "d", "e", "é", "f", "hot", "hot", "hot", "hot"]
    rows = [(rng.choice([None, "en", "fr"]), rng.choice(sources), rng.choice(texts)) for _ in range(400)]
    return [*rows, ("lone", "x", "hi"), ("lone", "y", None), ("one", "z", "b b")]


@pytest.mark.parametrize("block, tile", [(256, 1 << 16), (3, 6), (1, 1)])
def test_against_brute_force(spark, docs, block, tile):
    table = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = divergence.audit(table, min_docs=3, top_terms=4, block=block, tile=tile)
    assert sorted(map(tuple, got.collect())) == brute(docs, 3, 4)


def test_long_texts_are_counted_whole(spark, monkeypatch):
    text = "Ab cd " * 400_000 + "end"
    got = divergence.term_counts(spark.createDataFrame([("en", "a", text), ("en", "a", "ab")], SCHEMA))
    assert {r.term: (r.n, r.n_docs) for r in got.collect()} == {"ab": (400_001, 2), "cd": (400_000, 1), "end": (1, 1)}


def test_shares_are_exact_beyond_doubles(spark):
    big = 3 * 10**15
    row = spark.range(1).select(divergence._share(F.lit(big).cast("long"), F.lit(7 * big).cast("long"), F.lit(10**6).cast("long"), 10**9, 5).alias("p"))
    assert row.first().p == 1 + 10**9 * (big + 5) // (7 * big + 5 * 10**6)


def test_edges(edge_docs, no_docs):
    got = divergence.audit(edge_docs, min_docs=2)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute([(r.lang, r.source, r.text) for r in edge_docs.collect()], 2, 50)
    assert sorted(map(tuple, got.collect())) == want
    assert divergence.audit(no_docs).count() == 0
