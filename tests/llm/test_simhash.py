import hashlib
import json
import random

import numpy as np
import pytest
import xxhash

from classmeter.llm import simhash
from classmeter.llm.components import components


def plain_fingerprint(text, words=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [p for p in "".join(" " if c in " \t\n\x0b\f\r" else c for c in lowered).split(" ") if p]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def reach(nodes, linked):
    """Smallest member of each node's component."""
    out, seen = {}, set()
    for start in sorted(nodes):
        if start in seen:
            continue
        todo, part = [start], {start}
        while todo:
            x = todo.pop()
            for y in nodes:
                if y not in part and linked(x, y):
                    part.add(y)
                    todo.append(y)
        seen |= part
        out.update({x: min(part) for x in part})
    return out


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "One two THREE", "a b\tc\x0bd  e f É é", "x y z " * 20_000])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text.encode() if text is not None else None, 3) == signed(plain_fingerprint(text))


def test_golay_code():
    code = simhash.Golay()
    codewords = np.array([(m << 11) | code._remainder(m << 11) for m in range(1 << 12)])
    words = np.random.default_rng(0).integers(0, 1 << 23, 300)
    apart = np.bitwise_count(codewords[None, :] ^ words[:, None])
    assert (apart.argmin(axis=1) == code.nearest(words)).all() and apart.min(axis=1).max() <= 3
    place, index = code.within_four(words)
    assert sorted(zip(place.tolist(), index.tolist())) == [tuple(x) for x in np.argwhere(apart <= 4).tolist()]


@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_are_all_close_pairs(spark, max_bits):
    rng = random.Random(max_bits)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            prints.add(y)
    # every pair of segments: one bit in each of two, two in one
    x = rng.getrandbits(64)
    prints |= {x, *(x ^ (1 << a) ^ (1 << b) for a in (0, 21, 22, 42, 43, 63) for b in (1, 20, 23, 41, 44, 62))}
    rows = sorted(signed(p) for p in prints)
    expected = {(a, b) for a in rows for b in rows if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= max_bits}
    found = simhash.links(spark.createDataFrame([(p,) for p in rows], "fp long"), max_bits)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_more_bits_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 3)


def test_components(spark):
    chain = [(i, i + 1) for i in range(-50, 150)]
    star = [(1_000, x) for x in range(1_001, 1_060)]
    edges = spark.createDataFrame([*chain, *star, (5_000, 5_001), (7, 7)], "a long, b long")
    groups = {}
    for r in components(edges).collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(min, groups.values())) == [-50, 1_000, 5_000]
    assert sorted(map(len, groups.values())) == [2, 60, 201]
    assert components(edges.limit(0)).collect() == []


def test_near_duplicates(edge_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    prints = {(r.doc_id, r.text): signed(plain_fingerprint(r.text)) for r in rows}
    close = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2
    group = reach(set(prints.values()), close)
    lowest = {}
    for (doc_id, _), fp in prints.items():
        if doc_id is not None:
            lowest[group[fp]] = min(doc_id, lowest.get(group[fp], doc_id))
    expected = sorted((str(r.doc_id), prints[r.doc_id, r.text], str(lowest.get(group[prints[r.doc_id, r.text]]))) for r in rows)
    found = simhash.near_duplicates(edge_docs)
    assert found.columns == ["doc_id", "fp", "component_id", "group"]
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in found.collect()) == expected

    kept = simhash.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    kept = kept.collect()
    assert len(kept) == len(set(group.values()))
    assert len({group[prints[r.doc_id, r.text]] for r in kept}) == len(kept)


def test_the_one_kept_does_not_depend_on_partitions(spark):
    """Rows that repeat an id inside a component, also with other texts, and equal rows."""
    rows = [(1, "a b", "x"), (1, "A B", "x"), (2, "a b", "x"), (1, "a b", "x"), (None, "a b", None), (5, "c d", None), (5, "C D", None), (5, "c d", "y"), (None, "e", "x"), (None, "E", "x"), (7, None, None), (3, "", "z")]
    schema = "doc_id long, text string, source string"
    frame = spark.createDataFrame(rows, schema)
    digest = lambda r: hashlib.sha256(json.dumps({k: v for k, v in zip(("doc_id", "text", "source"), r) if v is not None}, separators=(",", ":")).encode()).hexdigest()
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").lower(), []).append(r)
    want = sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0, digest(r))) for g in groups.values()), key=str)
    for n in (1, 2, 3, 5, 7):
        got = simhash.one_of_each(frame.repartition(n), max_bits=0)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_without_documents(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.one_of_each(no_docs).collect() == []
