"""Conversation structure repair: the cheapest edits that bring the roles of a conversation in order.

Rows of a conversation become symbols of role and fault, a conversation a
sequence of them in pieces of PIECE rows. Re-Pair compresses the different
pieces: in rounds, Spark counts adjacent pairs over all of them and the most
frequent pairs become symbols of their own, each a rule (left, right). A symbol
has one transfer matrix over the four states of the role pattern, its entries
the least cost and the edits as a rope; the matrix of a rule is the min-plus
product of its two parts, worked out bottom-up once and shared by all pieces.
A conversation is the product of its pieces' matrices.

What a conversation holds is never gathered into one task except its result:
rows are numbered by ranges, so a conversation with very many turns is dealt out
over blocks; its pieces are evaluated apart; pieces are then folded, and the
repaired lines hashed, as a stream. Texts are shuffled by (conversation, digest).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from classmeter.functions.numbering import number_within
from classmeter.llm.common import saved

# Rows in a piece; rules of the grammar at most, and pairs that become rules in one round.
PIECE, MAX_RULES, RULES_IN_ROUND = 1024, 48, 8

# Fixed by the contract: costs of edits, and the order of roles (s?(ua)+)?.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
BEGUN, SYSTEM, USER, ASSISTANT = range(4)
STATES, ACCEPTED = range(4), (BEGUN, ASSISTANT)
STEPS = {(BEGUN, "s"): SYSTEM, (BEGUN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_SOLID = r"[^\x20\x09-\x0D]"

# A row's code: its role's initial (s, u, a, another) and its fault (none, truncated, blank, duplicate).
CODES = "abcdefghijklmnop"
_INITIALS = "ssssuuuuaaaaoooo"
# A row's symbol: x must go; capitals are truncated.
_SYMBOLS = "sSxxuUxxaAxxoOxx"
_TO_INITIALS = str.maketrans(CODES, _INITIALS)
BASE = "sSuUaAoOx"


class Rope:
    """A text as a tree; equal parts are one object, so that comparing two ropes passes over what they share."""

    __slots__ = ("left", "right", "text", "length")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.length = len(text) if left is None else left.length + right.length

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            rope = stack.pop()
            if rope.left is None:
                yield rope.text
            else:
                stack += (rope.right, rope.left)

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y:
                continue
            if x.left is None and y.left is None:
                n = min(x.length, y.length)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                a += [Rope(x.text[n:])] if x.length > n else []
                b += [Rope(y.text[n:])] if y.length > n else []
            elif y.left is None or (x.left is not None and x.length >= y.length):
                a += (x.right, x.left)
                b.append(y)
            else:
                a.append(x)
                b += (y.right, y.left)
        return not a and bool(b)


Matrix = dict[tuple[int, int], tuple[int, Rope]]

_INSERTED = {(0, 2): "I", (0, 3): "II", (1, 2): "I", (1, 3): "II", (2, 3): "I", (3, 2): "I"}


class Algebra:
    """Transfer matrices in the min-plus algebra; of equal costs the ASCII-least edits."""

    def __init__(self):
        self.nothing = Rope("")
        self._leaf = {c: Rope(c) for c in "DIKR"}
        self._joined: dict[tuple[int, int], Rope] = {}
        both = self.join(self._leaf["I"], self._leaf["I"])
        self.inserts: Matrix = {(i, i): (0, self.nothing) for i in STATES}
        self.inserts |= {at: (INSERT * len(e), self._leaf["I"] if e == "I" else both) for at, e in _INSERTED.items()}

    def join(self, a: Rope, b: Rope) -> Rope:
        if not a.length or not b.length:
            return a if a.length else b
        key = (id(a), id(b))
        if key not in self._joined:
            self._joined[key] = Rope(left=a, right=b)
        return self._joined[key]

    def times(self, a: Matrix, b: Matrix) -> Matrix:
        out: Matrix = {}
        for (i, k), (cost, edits) in a.items():
            for j in STATES:
                if (k, j) in b:
                    more, then = b[k, j]
                    found = (cost + more, self.join(edits, then))
                    if (i, j) not in out or found < out[i, j]:
                        out[i, j] = found
        return out

    def row(self, symbol: str) -> Matrix:
        """What may be inserted before a row, and then what may be done with it."""
        own: Matrix = {(i, i): (DELETE, self._leaf["D"]) for i in STATES}
        if symbol != "x":
            extra = CUT_OFF if symbol.isupper() else 0
            for (i, initial), j in STEPS.items():
                if initial == symbol.lower():
                    found = (extra, self._leaf["K"])
                elif initial != "s":
                    found = (REROLE + extra, self._leaf["R"])
                else:
                    continue
                if (i, j) not in own or found < own[i, j]:
                    own[i, j] = found
        return self.times(self.inserts, own)


def _mark(symbol: int) -> str:
    """The character of a symbol: a base symbol, or rule number `symbol` - len(BASE)."""
    return BASE[symbol] if symbol < len(BASE) else chr(0xE000 + symbol - len(BASE))


class Grammar:
    """Rules in the order they were made; a rule's parts come before it."""

    def __init__(self, rules: Sequence[str] = ()):
        self.rules = list(rules)  # two characters each

    def mark(self, rule: int) -> str:
        return _mark(len(BASE) + rule)

    def compress(self, shape: Column) -> Column:
        for i, pair in enumerate(self.rules):
            shape = F.replace(shape, F.lit(pair), F.lit(self.mark(i)))
        return shape

    def matrices(self, algebra: Algebra) -> dict[str, Matrix]:
        found = {c: algebra.row(c) for c in BASE}
        for i, (left, right) in enumerate(self.rules):
            found[self.mark(i)] = algebra.times(found[left], found[right])
        return found


def _pairs(shape: Column) -> Column:
    """Adjacent symbols of a sequence; of a run of one symbol every second pair, as they are replaced."""
    places = F.when(F.char_length(shape) > 1, F.sequence(F.lit(1), F.char_length(shape) - 1)).otherwise(F.array().cast("array<int>"))
    each = F.transform(places, lambda i: F.substring(shape, i, F.lit(2)))
    mixed = F.filter(each, lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    return F.concat(mixed, F.regexp_extract_all(shape, F.lit(r"(.)\1"), F.lit(0)))


def learn(shapes: DataFrame, max_rules: int = MAX_RULES, in_round: int = RULES_IN_ROUND, least: int = 2) -> Grammar:
    """A Re-Pair grammar of the different sequences in `shape`.

    A round counts the pairs of all sequences. The most frequent becomes a rule,
    and after it the next ones that share no symbol with those of the round, which
    gives what one pair at a time would replace. At most (symbols)^2 counts exist.
    """
    grammar = Grammar()
    while len(grammar.rules) < max_rules:
        pairs = shapes.select(F.explode(_pairs(grammar.compress(F.col("shape")))).alias("pair"))
        counts = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        used: set[str] = set()
        taken: list[str] = []
        for row in counts.orderBy(F.desc("n"), "pair").limit(4 * in_round * in_round).collect():
            if not used & set(row.pair) and len(taken) < in_round:
                used |= set(row.pair)
                taken.append(row.pair)
        if not taken:
            break
        grammar.rules += taken[: max_rules - len(grammar.rules)]
    return grammar


def _evaluator(rules: list[str]):
    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        algebra = Algebra()
        table = Grammar(rules).matrices(algebra)
        for batch in batches:
            costs, edits = [], []
            for packed in batch.column("packed").to_pylist():
                whole: Matrix = {(i, i): (0, algebra.nothing) for i in STATES}
                for symbol in packed:
                    whole = algebra.times(whole, table[symbol])
                every = [(i, j) for i in STATES for j in STATES]
                costs.append([whole[at][0] if at in whole else None for at in every])
                edits.append([str(whole[at][1]) if at in whole else None for at in every])
                if len(algebra._joined) > 1 << 18:  # ropes of single pieces are not kept for ever
                    algebra = Algebra()
                    table = Grammar(rules).matrices(algebra)
            yield pa.RecordBatch.from_arrays([batch.column("shape"), pa.array(costs, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string()))], ["shape", "costs", "edits"])

    return evaluate


class _Node:
    """The cheapest way to a state after some pieces: cost, edits of the last piece, and the way before it."""

    __slots__ = ("cost", "edits", "before")

    def __init__(self, cost: int, edits: str, before: _Node | None):
        self.cost, self.edits, self.before = cost, edits, before


def _less(a: _Node, b: _Node, after_a: str = "", after_b: str = "") -> bool:
    """Whether a's cost and edits come before b's. Both ways have as many pieces."""
    if a.cost != b.cost:
        return a.cost < b.cost
    x, y = [after_a], [after_b]
    while a is not b:
        x.append(a.edits)
        y.append(b.edits)
        a, b = a.before, b.before
    return "".join(reversed(x)) < "".join(reversed(y))


def _acts(edits: str, codes: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """For each row, and for what follows the last one: roles inserted before it (U, A), and k, u, a or
    nothing for itself. And the state after them."""
    out, inserted, rows = [], "", iter(codes)
    for edit in edits:
        if edit == "I":
            inserted += "A" if state == USER else "U"
            state = ASSISTANT if state == USER else USER
            continue
        initial, own = _INITIALS[CODES.index(next(rows))], ""
        if edit == "K":
            own, state = "k", STEPS[state, initial]
        elif edit == "R":
            own = "a" if state == USER else "u"
            state = ASSISTANT if state == USER else USER
        out.append((inserted, own))
        inserted = ""
    return [*out, (inserted, "")], state


_FIGURES = ("cost", "blank", "duplicate", "truncated", "illegal")
_FOLDED = "key string, piece long, edits string, acts array<struct<ins:string,own:string>>, " + ", ".join(f"{c} long" for c in _FIGURES)
_FOLDED_TYPES = {
    "key": pa.string(), "piece": pa.int64(), "edits": pa.string(),
    "acts": pa.list_(pa.struct([("ins", pa.string()), ("own", pa.string())])), **{c: pa.int64() for c in _FIGURES},
}


def _whole(parts: list[tuple[int, str]], ways: dict[int, _Node]) -> Iterator[tuple]:
    """A row for each piece of a conversation; its figures stand at the first piece."""
    best: tuple[_Node, str] | None = None
    for state, node in ways.items():
        for end in ACCEPTED:
            tail = "" if state == end else _INSERTED.get((state, end))
            if tail is None:
                continue
            found = _Node(node.cost + INSERT * len(tail), node.edits, node.before)
            if best is None or _less(found, best[0], tail, best[1]):
                best = (found, tail)
    node, tail = best
    cost, edits = node.cost, [node.edits + tail]
    while (node := node.before).before is not None:
        edits.append(node.edits)
    counts, illegal, last = [0, 0, 0], 0, ""
    for _, codes in parts:
        for i, faults in enumerate(("cgko", "dhlp", "bfjn")):  # blank, duplicate, truncated
            counts[i] += sum(map(codes.count, faults))
        initials = last + codes.translate(_TO_INITIALS)
        illegal += sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
        last = initials[-1]
    state = BEGUN
    for n, ((piece, codes), own) in enumerate(zip(parts, reversed(edits))):
        acts, state = _acts(own, codes, state)
        yield (piece, own, [{"ins": i, "own": o} for i, o in acts], *((cost, *counts, illegal) if n == 0 else (None,) * 5))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations out of their pieces, which come in order."""
    out: list[tuple] = []
    key, parts, ways = None, [], {}

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(_FOLDED_TYPES)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOLDED_TYPES.values())], list(_FOLDED_TYPES))

    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                out += [(key, *x) for x in _whole(parts, ways)] if key is not None else []
                key, parts, ways = row["key"], [], {BEGUN: _Node(0, "", None)}
            after: dict[int, _Node] = {}
            for i, node in ways.items():
                for j in STATES:
                    cost = row["costs"][4 * i + j]
                    if cost is not None:
                        found = _Node(node.cost + cost, row["edits"][4 * i + j], node)
                        if j not in after or _less(found, after[j]):
                            after[j] = found
            ways = after
            parts.append((row["piece"], row["codes"]))
            if len(out) >= 4096:
                yield flush()
    if key is not None:
        out += [(key, *x) for x in _whole(parts, ways)]
    yield flush()


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's lines, which come in order; one line at a time is held."""
    key, digest = None, None
    for batch in batches:
        keys, digests = [], []
        for next_key, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist()):
            if next_key != key:
                if key is not None:
                    keys.append(key)
                    digests.append(digest.hexdigest())
                key, digest = next_key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["key", "repaired_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])


def _key(conv_id: Column) -> Column:
    """A conversation's id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after the test damage: by crc32(`conv_id:turn`) % 20 a row goes (0), its text is
    emptied (1) or loses its [.!?] (2), it stands twice (3), or its role is user (4). Nulls are one space, but for conv_id and turn themselves."""
    blank = F.lit(" ")
    conv, turn = F.col(conv_col), F.col(turn_col)
    fate = F.crc32(F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))) % 20
    rows = conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col(role_col).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text_col), blank).alias("text"), fate.alias("fate"),
    ).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "fate")
    twice = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("time")
    return rows.select("conv_id", "turn", "role", "text", twice).drop("time")


def _digest(role: Column, text: Column) -> Column:
    """What tells two rows apart: SHA-256 of role and text."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


class Repair:
    """The repair of conversations given as (conv_id, turn, role, text).

    Rows go by turn (nulls first), those of one turn by role and then by a
    digest of role and text. Null roles and texts count as one space. A null
    conv_id is a conversation of its own. Rows that are equal are duplicates
    from the second on. No rows give no conversations.

    * `edits`: (key, piece, edits, acts, figures at the first piece);
    * `lines`: (key, place, line), the repaired rows in order;
    * `summary()`: a row for each conversation with rows.
    """

    def __init__(self, rows: DataFrame, piece: int = PIECE, max_rules: int = MAX_RULES):
        blank = F.lit(" ")
        role, text = F.coalesce("role", blank), F.coalesce("text", blank)
        self._rows = rows.select(_key(F.col("conv_id")).alias("key"), "turn", role.alias("role"), text.alias("text"), _digest(role, text).alias("digest"))
        initial = F.substring("role", 1, 1)
        kind = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12)
        fault = F.when(~F.col("text").rlike(_SOLID), 2).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 1).otherwise(0)
        narrow = self._rows.select("key", "turn", "role", "digest", kind.alias("kind"), fault.alias("fault"))
        order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
        placed = number_within(narrow, ["key"], order, "place").drop("role")
        first = placed.groupBy("key", "digest").agg(F.min("place").alias("place")).select("key", "place", F.lit(True).alias("first"))
        seen = placed.join(first, ["key", "place"], "left")
        fault = F.when((F.col("fault") != 2) & F.col("first").isNull(), 3).otherwise(F.col("fault"))
        code = F.substring(F.lit(CODES), F.col("kind") + fault + 1, F.lit(1))
        self.placed = saved(seen.select("key", "turn", "place", "digest", code.alias("code"), F.expr(f"(place - 1) div {piece}").alias("piece")), "turns")
        codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "")
        pieces = saved(self.placed.groupBy("key", "piece").agg(codes.alias("codes")), "turn-pieces")
        shape = F.translate("codes", CODES, _SYMBOLS)
        shapes = saved(pieces.select(shape.alias("shape")).distinct(), "turn-shapes")
        self.grammar = learn(shapes, max_rules)
        packed = shapes.select("shape", self.grammar.compress(F.col("shape")).alias("packed"))
        tables = packed.mapInArrow(_evaluator(self.grammar.rules), "shape string, costs array<bigint>, edits array<string>")
        # Written, so that the join deals both sides anew and Spark can split a shape that many pieces have.
        known = pieces.withColumn("shape", shape).join(saved(tables, "turn-matrices"), "shape").drop("shape")
        known = saved(known, "turn-evaluated")
        folded = known.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(_fold, _FOLDED)
        self.edits = saved(folded, "turn-edits")
        self._piece = piece

    @property
    def lines(self) -> DataFrame:
        acts = self.edits.select("key", "piece", F.posexplode("acts").alias("at", "act"))
        acts = acts.where("act.ins <> '' OR act.own <> ''")
        acts = acts.select("key", (F.col("piece") * self._piece + F.col("at") + 1).alias("place"), "act.ins", "act.own")
        kept = acts.where("own <> ''").join(self.placed.select("key", "place", "digest"), ["key", "place"])
        texts = self._rows.select("key", "digest", "role", "text").dropDuplicates(["key", "digest"])
        own = F.when(F.col("own") == "k", F.concat("role", F.lit(":"), "text"))
        own = own.when(F.col("own") == "u", F.concat(F.lit("user:"), "text")).otherwise(F.concat(F.lit("assistant:"), "text"))
        held = kept.join(texts, ["key", "digest"]).select("key", "place", F.lit(1).alias("part"), own.alias("line"))
        ins = F.rtrim(F.replace(F.replace("ins", F.lit("U"), F.lit("user:\n")), F.lit("A"), F.lit("assistant:\n")), F.lit("\n"))
        # The place after a piece's last row is that of the next piece's first, which comes after it.
        added = acts.where("ins <> ''").select("key", "place", F.when(F.col("own") == "", -1).otherwise(0).alias("part"), ins.alias("line"))
        return held.union(added)

    def summary(self) -> DataFrame:
        """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
        gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        turns = self.placed.groupBy("key").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "edits"))), lambda x: x["edits"]), "")
        figures = [F.max(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        found = self.edits.groupBy("key").agg(*figures, audit.alias("audit"))
        ordered = self.lines.repartition("key").sortWithinPartitions("key", "place", "part").select("key", "line")
        digests = ordered.mapInArrow(_hash_lines, "key string, repaired_sha256 string")
        return turns.join(found, "key").join(digests, "key", "left")


def audit(conversations: DataFrame, rows: DataFrame, conv_col: str = "conv_id", piece: int = PIECE, max_rules: int = MAX_RULES) -> DataFrame:
    """One row for each different conv_id of `conversations`: the repair of its `rows` (conv_id, turn, role, text).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 (of the repaired lines `role:text`, joined by newlines).
    A conversation without rows has zeros, an empty audit and the digest of the
    empty text. Other columns are not read.
    """
    every = conversations.select(F.col(conv_col).alias("conv_id")).distinct().withColumn("key", _key(F.col("conv_id")))
    found = every.join(saved(Repair(rows, piece, max_rules).summary(), "turn-audits"), "key", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return found.select(F.col("conv_id").alias(conv_col), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
