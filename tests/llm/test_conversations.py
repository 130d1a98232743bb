import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from classmeter.llm import conversations
from classmeter.llm.common import SPACES

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def damage(rows):
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        row = (conv, turn, "user" if fate == 4 else role, text)
        yield from [row] * (0 if fate == 0 else 2 if fate == 3 else 1)


def solve(rows):
    """Shortest path over (row, state) by (cost, edits)."""
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r)))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = (("u", "user"), ("a", "assistant"))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, edits, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            body = "\n".join(out).encode()
            return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256(body).hexdigest())
        if (i, state) in done:
            continue
        done.add((i, state))
        ways = [(2, "I", i, x, f"{name}:") for x, name in names]
        if i < len(rows):
            role, text = rows[i][2:]
            cut = faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                ways += [(cut, "K", i + 1, initials[i], f"{role}:{text}")]
                ways += [(2 + cut, "R", i + 1, x, f"{name}:{text}") for x, name in names]
        for more, edit, to, x, line in ways:
            if (state, x) in step:
                heapq.heappush(heap, (cost + more, edits + edit, to, step[state, x], (*out, line)))


def expected(rows):
    by = defaultdict(list)
    for row in damage(rows):
        by[row[0]].append(row)
    return {c: solve(by[c]) if by[c] else (0, 0, 0, 0, 0, 0, "", EMPTY) for c in {r[0] for r in rows}}


def repaired(frame, **how):
    got = conversations.audit(frame, conversations.damaged(frame), **how).collect()
    assert len(got) == len({r[0] for r in got})
    return {r[0]: tuple(r)[1:] for r in got}


@pytest.fixture(scope="module")
def rows():
    """Short conversations of all kinds, with null ids and turns and repeated rows, and one that is much longer."""
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "u", "", "user", "assistant"]
    made = [
        (c or None, rng.choice([t, t, t, None, t // 2]), rng.choice(roles), rng.choice(["a.", "b", "", "  ", None, f"x{t}.", f"y{t}!  ", f"zé{t}"]))
        for c in range(150)
        for t in range(rng.randint(1, 14))
    ]
    made += [(777, t, rng.choice(roles[:4]), f"x{rng.randint(0, 2000)}" + rng.choice([".", ""])) for t in range(1200)]
    return made + rng.sample(made, 50)


@pytest.mark.parametrize("piece, rules", [(1024, 48), (7, 5), (1, 0)])
def test_against_shortest_paths(spark, rows, piece, rules):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert repaired(frame, piece=piece, max_rules=rules) == expected(rows)


def test_partitions_do_not_matter(spark, rows):
    frame = spark.createDataFrame(rows[:300] + rows[-50:], SCHEMA)
    assert repaired(frame.coalesce(1)) == repaired(frame.repartition(7, "text"))


def test_rules_replace_the_most_frequent_pair(spark):
    shapes = ["uauaua", "suaua", "uaUA", "uuu"]
    grammar = conversations.learn(spark.createDataFrame([(s,) for s in shapes], "shape string"), max_rules=2, in_round=1)
    assert grammar.rules == ["ua", grammar.mark(0) * 2]


def test_a_rule_is_the_product_of_its_parts():
    algebra = conversations.Algebra()
    grammar = conversations.Grammar(["ua", chr(0xE000) + "U"])
    tables = grammar.matrices(algebra)
    u, a, cut = (algebra.row(c) for c in "uaU")
    spelt = lambda m: {at: (cost, str(edits)) for at, (cost, edits) in m.items()}
    assert spelt(tables[grammar.mark(1)]) == spelt(algebra.times(algebra.times(u, a), cut))


def test_ropes_compare_like_texts():
    rng = random.Random(1)
    algebra = conversations.Algebra()
    ropes = [conversations.Rope(c) for c in ("D", "I", "KD", "R")]
    for _ in range(200):
        ropes.append(algebra.join(*rng.sample(ropes[-30:], 2)))
    ropes = [r for r in ropes if r.length < 200]
    for _ in range(500):
        a, b = rng.sample(ropes, 2)
        assert (a < b) == (str(a) < str(b))


def test_edges(spark):
    schema = SCHEMA + ", " + ", ".join(f"`{c}` string" for c in ("key", "place", "piece", "codes", "digest", "kind", "fault", "line"))
    rows = [(1, None, None, None), (1, None, None, None), (None, None, "user", "Long. " * 200_000), (2, 5, "", "x"), (None, 3, "assistant", "Ünicode?")]
    frame = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], schema)
    assert repaired(frame) == expected(rows)
    assert repaired(frame.limit(0)) == {}
