import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from classmeter.llm import pii

# The contract's own patterns.
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        odd = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
        return 13 <= len(digits) <= 19 and (sum(odd) + sum(digits[::-2])) % 10 == 0
    return True


def base(text):
    found = [(k, m) for k, p in GIVEN.items() for m in re.finditer(p, text or "") if passes(k, m.group())]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


def scanned(docs, **how):
    found = pii.scan(docs, **how)
    return found.select("doc_id", pii.as_text(F.col("base")).alias("base"), pii.as_text(F.col("spans")).alias("spans")).collect()


def test_base_spans_are_the_contracts(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "x.y@z-1.co.uk", "q@w", "+1 (123) 555-0000", "+12", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1"]
    bits += ["001.2.3.4.5", " ", "..", "@", "é😀", "12", "- ", "(", "+", "abc_d", "a@b.c_d@e.f", "9" * 20, "%", "\n"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(400)]
    rows += [(1, None), (None, "a@b.cc"), (3, "a@b.cd " * 700 + " 😀 " + "1.2.3.4 " * 700)]
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter((r.doc_id, r.base) for r in got) == Counter((i, base(t)) for i, t in rows)
    for r in got:
        assert set(r.base.split(",")) <= set(r.spans.split(",")) or not r.base


def test_long_runs_are_searched_once(spark):
    text = "x" * 200_000 + " 1.2.3.4 " + "7" * 100_000
    assert [r.base for r in scanned(spark.createDataFrame([(2, text)], "doc_id long, text string"))] == ["ip:200001:200008"]


@pytest.fixture(scope="module")
def calls():
    """Telephone numbers after `call me at`, most in the fixed form, and other numbers elsewhere."""
    seeds = [(i, f"word{chr(97 + i)} call me at +1 (20{i % 10}) 555-01{i:02d} soon") for i in range(12)]
    return [
        *seeds,
        (20, "hey call me at (415) 555-2671 soon"),
        (21, "here call me at 415-555-9999 soon"),
        (22, "order number 4165552222 soon"),
        (23, "again 415.555.2671 hm"),
        (24, "call me at 1999 soon"),
        (25, "é reached by tel 1-200-555-0100 now"),
        (20, "hey call me at (415) 555-2671 soon"),
    ]


def test_contexts_find_unseen_identifiers(spark, calls):
    got = scanned(spark.createDataFrame(calls, "doc_id long, text string").repartition(3))
    texts = dict(calls)
    added = {}
    for r in got:
        new = [s.split(":") for s in r.spans.split(",") if s and s not in r.base.split(",")]
        added[r.doc_id] = [(k, texts[r.doc_id][int(a) : int(b)]) for k, a, b in new]
    assert added[20] == [("phone", "(415) 555-2671")] and added[21] == [("phone", "415-555-9999")]
    assert added[23] == [("phone", "415.555.2671")]  # found elsewhere, by its digits
    assert added[25] == [("phone", "1-200-555-0100")]  # a seed in other writing
    assert not any(added[i] for i in (*range(12), 22, 24))
    assert len(got) == len(calls)


def test_scores_are_those_of_the_graph(spark):
    rows = [("i%d" % i, "phone", ["phone"], ["at _"]) for i in range(6)] + [("u", None, ["phone"], ["at _", "the _"]), ("o", "ip", ["ip"], ["the _"])]
    rows += [("x", None, ["card"], ["the _"]), ("y", None, ["phone"], ["lone _"])]
    found = spark.createDataFrame(rows, "instance string, kind string, kinds array<string>, contexts array<string>")
    got = {r.instance: (r.kind, r.score) for r in pii.bootstrap(found, rounds=1).collect()}
    # at: 6 seeds, one open instance that counts half, and 1.
    assert got.pop("u") == ("phone", 0.8) and got == {**{f"i{i}": ("phone", 1.0) for i in range(6)}, "o": ("ip", 1.0)}
    two = {r.instance: r.score for r in pii.bootstrap(found, rounds=2).collect()}
    assert two["u"] == pytest.approx(6.8 / 7.9, abs=1e-9)


def test_partitions_and_copies_do_not_matter(spark, calls):
    frame = spark.createDataFrame(calls, "doc_id long, text string")
    assert sorted(scanned(frame.coalesce(1))) == sorted(scanned(frame.repartition(6)))
    assert set(scanned(frame.union(frame))) == set(scanned(frame))


def test_no_python_on_the_way(spark, calls, monkeypatch):
    from classmeter.llm import common

    plans = []

    def spied(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.saved(df, purpose)

    monkeypatch.setattr(pii, "saved", spied)
    out = pii.scan(spark.createDataFrame(calls, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5
    for plan in plans:
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_edges(edge_docs, no_docs):
    got = scanned(edge_docs)
    assert Counter((r.doc_id, r.base) for r in got) == Counter((r.doc_id, base(r.text)) for r in edge_docs.collect())
    assert scanned(no_docs) == []
