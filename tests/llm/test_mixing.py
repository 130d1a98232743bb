import random
from fractions import Fraction
from itertools import product

import pytest
from pyspark.sql import functions as F

from classmeter.llm import mixing


def test_targets_fill_up_to_the_cap():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300, 3) == [Fraction(1500, 8), 75, Fraction(300, 8)]
    # the first would get 625 of 1000 and may have 30; the others share what is over, 2 to 1
    assert mixing.targets([10, 490, 500], [5, 2, 1], 1000, 3) == [30, Fraction(1940, 3), Fraction(970, 3)]
    assert mixing.targets([10, 20, 970], [5, 2, 1], 1000, 3) == [30, 60, 910]
    assert mixing.targets([0, 0], [5, 2], 0, 3) == [0, 0]
    assert mixing.targets([0, 8], [5, 2], 8, 3) == [0, 8]
    assert mixing.targets([], [], 0, 3) == []


def test_quotas_are_whole_and_add_up():
    assert mixing.quotas([Fraction(1, 2), Fraction(1, 2), Fraction(4)]) == [1, 0, 4]
    assert sum(mixing.quotas([Fraction(100, 3)] * 3)) == 100


def cost_of(sizes, flow, most):
    taken = [0] * len(sizes)
    for (p, _), words in flow.items():
        taken[p] += words
    return sum(min(max(t - r * s, 0), s) * r for t, s in zip(taken, sizes) for r in range(most))


@pytest.mark.parametrize(
    "sizes, members, quota",
    [
        ([2, 3], [[0], [0, 1]], [4, 3]),
        ([1, 2, 2], [[0], [0, 1], [1]], [4, 3]),
        ([2, 1, 1], [[0, 1], [1], [0]], [3, 4]),
        ([2], [[0, 1]], [5, 5]),
        ([0, 2], [[0], [1]], [3, 1]),
    ],
)
def test_flow_is_largest_and_cheapest(sizes, members, quota):
    most = 2
    arcs = [(p, s) for p, ss in enumerate(members) for s in ss]
    best = None
    for words in product(*(range(most * sizes[p] + 1) for p, _ in arcs)):
        flow = dict(zip(arcs, words))
        if any(sum(w for (p, _), w in flow.items() if p == i) > most * n for i, n in enumerate(sizes)):
            continue
        if any(sum(w for (_, s), w in flow.items() if s == j) > q for j, q in enumerate(quota)):
            continue
        rank = (-sum(words), cost_of(sizes, flow, most))
        best = rank if best is None else min(best, rank)
    found = mixing.route(sizes, members, quota, most)
    assert (-sum(found.values()), cost_of(sizes, found, most)) == best
    assert all(sum(w for (_, s), w in found.items() if s == j) <= q for j, q in enumerate(quota))


@pytest.fixture(scope="module")
def overlapping(spark):
    names = [["a"], ["b"], ["a", "b"], ["c"], ["c", "a"], [None], ["b", None], [], None]
    rows = [(i, names[i % len(names)] if i % 5 else ["a"], i % 13) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    return docs.withColumn("key", mixing.seeded_key(F.col("doc_id"), F.lit(""), 3)).cache()


def test_overlapping_sources(overlapping):
    mix = mixing.plan_mix(overlapping, most=3)
    rows = mix.apply(overlapping).collect()
    wanted = {r.source: r.target for r in mix.sources.collect()}
    assert sorted(wanted, key=lambda n: (n is None, n or "")) == ["a", "b", "c", None]
    taken = dict.fromkeys(wanted, 0)
    for r in rows:
        assert r.copies == sum(t.copies for t in r.taken_by) <= 3
        assert {t.source for t in r.taken_by} <= set(r.sources or [])
        for t in r.taken_by:
            taken[t.source] += t.copies * r.size
    assert sum(wanted.values()) == pytest.approx(sum(r.size for r in rows if r.sources))
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 3 * 12 * 2  # a document at each end of each stretch
    # the hash decides alone, not the order of the rows
    again = mix.apply(overlapping.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in rows)


def test_stretches_follow_the_seeded_order(overlapping):
    """A pattern's copies are its documents in the order of the hash, in as many turns as the flow asks for."""
    rows = mixing.plan_mix(overlapping).apply(overlapping).collect()
    by_pattern = {}
    for r in rows:
        by_pattern.setdefault(frozenset(r.sources or []), []).append((r.key, r.copies))
    for found in by_pattern.values():
        copies = [c for _, c in sorted(found)]
        assert copies == sorted(copies, reverse=True) and copies[0] - copies[-1] <= 1


def test_too_many_patterns_are_an_error(overlapping):
    with pytest.raises(ValueError, match="patterns"):
        mixing.plan_mix(overlapping, max_patterns=3)


def rows_of(mix, docs):
    found = [(r.doc_id, r.copies, [(t.source, t.copies) for t in r.taken_by]) for r in mix.apply(docs).collect()]
    return sorted(found), sorted(mix.sources.collect(), key=lambda r: (r.source is None, r.source or ""))


@pytest.mark.parametrize("weights, most", [((5, 2, 1), 3), ((2, 4, 3, 2), 1), ((7,), 2)])
def test_any_number_of_sources(spark, weights, most):
    """Beyond max_patterns the same mix comes from joins: hot and tiny sources, ones without words, equal remainders."""
    rng = random.Random(len(weights))
    names = [None, "", "null", "=x", "é", "Z", "a", "😀", *(f"host{i}.org" for i in range(90))]
    rows = [(i, [names[0 if rng.random() < 0.3 else rng.randrange(len(names))]], rng.choice([0, 1, 1, 2, 7, 400])) for i in range(3_000)]
    rows += [(9_000 + i, names_, 5) for i, names_ in enumerate([[], None, ["empty"], ["empty"]])] + [(9_100, ["void"], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    docs = docs.withColumn("key", mixing.seeded_key(F.col("doc_id"), F.lit(""), 3)).cache()
    whole = mixing.plan_mix(docs, weights, most)
    apart = mixing.plan_mix(docs, weights, most, max_patterns=20)
    assert whole.bounded and not apart.bounded
    assert rows_of(apart, docs) == rows_of(whole, docs)
    assert rows_of(apart, docs.repartition(5)) == rows_of(apart, docs)


def test_many_sources_without_words(spark):
    docs = spark.createDataFrame([(i, [f"s{i}"], 0, i) for i in range(9)], "doc_id long, sources array<string>, size long, key long")
    mix = mixing.plan_mix(docs, max_patterns=3)
    assert [r.copies for r in mix.apply(docs).collect()] == [0] * 9 and {r.target for r in mix.sources.collect()} == {0.0}


def test_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        narrow = mixing.measured(docs, 7, "doc_id", "source").cache()
        out = mixing.plan_mix(narrow).apply(mixing.measured(docs, 7, F.struct("*").alias("row")))
        assert out.columns == ["row", "sources", "size", "key", "taken_by", "copies"]
        rows = out.collect()
        assert len(rows) == docs.count()
        copies = {}
        for r in rows:  # rows that repeat id and text share a decision
            assert copies.setdefault((r.row.doc_id, r.row.text, r.row.source), r.copies) == r.copies
    empty = spark.createDataFrame([(1, ["a"], 0, 5)], "doc_id long, sources array<string>, size long, key long")
    assert [r.copies for r in mixing.plan_mix(empty).apply(empty).collect()] == [0]


def test_word_count(spark):
    texts = [None, "", " \t", "a", "a\x0bb  c\n", "é ü"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count(F.col("text"))).collect()
    assert [r[0] for r in rows] == [0, 0, 0, 1, 3, 1]
