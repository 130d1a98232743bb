"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that list
them). Pattern -> source -> quota is a small network on the driver: a pattern
can send its words once for nothing, a second time at a cost of 1, a third
time at a cost of 2 and so on up to `max_repeats`; every source takes at most
its quota. The cheapest largest flow says how many words of each pattern each
source takes.

The documents of a pattern lie on a line in the order of a seeded hash, and
the line is run through once for each repetition. The flow cuts it into one
stretch per source. Where a cut falls between two documents is found by three
passes over a narrow table (pattern, hash, size): sums over 10 bits of the
hash, then over 14 more inside the one bucket of the cut, then over single
hashes inside that. All are partial sums before their shuffle, so a source
with a third of the rows costs no more than another. The documents themselves
are scanned once more, with the cuts at hand, and not shuffled.

The driver and the broadcasts hold one row for each pattern, source and cut.
`max_patterns` bounds them. Beyond it the flow is planned without the driver
where no document has two sources: each source then takes its quota from its
own pattern, and targets, quotas and cuts are worked out over a written table
of sources and joined to the documents. More patterns of overlapping sources
are an error.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from classmeter.functions.numbering import number_within
from classmeter.llm.common import WORD, saved

# Bits of the hash, and of them those in the first and the second pass.
KEY_BITS, FIRST, SECOND = 60, 10, 14
MAX_PATTERNS = 20_000


def word_count(text: Column) -> Column:
    """How many words a text has; a null one none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(doc_id: Column, text: Column, seed: int) -> Column:
    """The place of a document in the seeded order, of 60 bits. Rows that repeat id and text share it."""
    one = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(one.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int], total: int, most: int) -> list[Fraction]:
    """Shares of `total` by weight, none above `most` times its size; what is over goes to the others by weight."""
    order = sorted(range(len(sizes)), key=lambda i: Fraction(most * sizes[i], weights[i]))
    out, left, weight = [Fraction(0)] * len(sizes), total, sum(weights)
    for at, i in enumerate(order):
        if most * sizes[i] * weight >= weights[i] * left:
            for j in order[at:]:
                out[j] = Fraction(weights[j] * left, weight)
            break
        out[i] = Fraction(most * sizes[i])
        left, weight = left - most * sizes[i], weight - weights[i]
    return out


def quotas(wanted: Sequence[Fraction]) -> list[int]:
    """Whole numbers near `wanted` with its sum; the largest remainders are rounded up, the first ones on ties."""
    out = [int(x) for x in wanted]
    order = sorted(range(len(out)), key=lambda i: (out[i] - wanted[i], i))
    for i in order[: round(sum(wanted)) - sum(out)]:
        out[i] += 1
    return out


class Network:
    """Largest flow by shortest augmenting levels, over arcs with whole capacities."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, start: int) -> list[int]:
        level = [-1] * len(self.arcs)
        level[start] = 0
        queue = deque([start])
        while queue:
            x = queue.popleft()
            for e in self.arcs[x]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def fill(self, start: int, end: int) -> None:
        while (level := self._levels(start))[end] >= 0:
            at = [0] * len(self.arcs)
            path: list[int] = []
            x = start
            while True:
                if x == end:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, x = [], start
                    continue
                while at[x] < len(self.arcs[x]):
                    e = self.arcs[x][at[x]]
                    if self.room[e] and level[self.to[e]] == level[x] + 1:
                        break
                    at[x] += 1
                if at[x] < len(self.arcs[x]):
                    path.append(e)
                    x = self.to[e]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def route(sizes: Sequence[int], members: Sequence[Sequence[int]], quota: Sequence[int], most: int) -> dict[tuple[int, int], int]:
    """Words of pattern p that source s takes, by (p, s): the cheapest of the largest flows.

    A path leaves the start by one repetition arc, and only such arcs cost.
    So the cheapest augmenting paths are those of the first repetition while
    there are any, then those of the second, and so on: one largest flow after
    the other, each going on from the last, is the min-cost flow.
    """
    p, s = len(sizes), len(quota)
    net = Network(p + s + 2)
    start, end = p + s, p + s + 1
    taken = {(i, j): net.add(i, p + j, most * sizes[i]) for i in range(p) for j in members[i]}
    for j in range(s):
        net.add(p + j, end, quota[j])
    for _ in range(most):
        for i in range(p):
            net.add(start, i, sizes[i])
        net.fill(start, end)
    return {k: net.room[e ^ 1] for k, e in taken.items() if net.room[e ^ 1]}


@dataclass(frozen=True)
class Cut:
    """A place on the line of a pattern: words before it in its repetition, then the hash there."""

    pattern: int
    turn: int
    words: int


def _places(rows: DataFrame, cuts: list[Cut]) -> dict[Cut, int]:
    """For each cut the least hash that lies beyond it.

    All documents of one hash lie on one side: the side on which their middle is.
    """
    spark = rows.sparkSession
    found = {c: 0 for c in cuts if not c.words}
    live = [(i, c.pattern, 0, c.words) for i, c in enumerate(cuts) if c.words]
    known = 0
    for bits in (FIRST, FIRST + SECOND, KEY_BITS):
        if not live:
            break
        last = bits == KEY_BITS
        if last:  # unless a hash inside lies beyond the cut, the end of the bucket does
            found.update({cuts[i]: (stem + 1) << (KEY_BITS - known) for i, _, stem, _ in live})
        at = F.broadcast(spark.createDataFrame(live, "cut int, pattern int, stem long, words long"))  # a row for each cut
        inside = rows.withColumn("stem", F.shiftright("key", KEY_BITS - known) if known else F.lit(0).cast("long"))
        inside = inside.join(F.broadcast(at.select("pattern", "stem").distinct()), ["pattern", "stem"], "left_semi")
        sums = inside.groupBy("pattern", "stem", F.shiftright("key", KEY_BITS - bits).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("pattern", "stem").orderBy("bucket"))
        sums = sums.withColumn("upto", upto)
        beyond = F.expr("2 * upto - size > 2 * words" if last else "upto > words")
        hit = sums.join(at, ["pattern", "stem"]).where(beyond).groupBy("cut", "pattern", "words")
        hit = hit.agg(F.min("bucket").alias("bucket"), F.min(F.expr("upto - size")).alias("before"))
        live = [(r.cut, r.pattern, r.bucket, r.words - r.before) for r in hit.collect()]
        known = bits
    found.update({cuts[i]: key for i, _, key, _ in live})
    return found


def _pattern(sources: Column) -> Column:
    """A set of sources without nulls or repeats, in one order: =name, or null for the source without a name."""
    named = F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("null")))
    return F.array_sort(F.array_distinct(named))


@dataclass
class Mix:
    """What a mix takes: `sources` (source, source_size, target) and, per pattern, the stretches of the line.

    `bounded` says that neither has more rows than `max_patterns`, so both may be broadcast.
    """

    sources: DataFrame
    stretches: DataFrame
    bounded: bool = True

    def side(self, table: DataFrame) -> DataFrame:
        """A table of sources or patterns as the side of a join."""
        return F.broadcast(table) if self.bounded else table

    def apply(self, docs: DataFrame, sources_col: str = "sources", size_col: str = "size", key_col: str = "key") -> DataFrame:
        """`docs` with taken_by (a struct of source and copies for each source that
        takes the document) and copies (their sum). Not shuffled if `bounded`;
        columns of `docs` with these names are replaced."""
        row = docs.select(F.struct("*").alias("_row"), _pattern(F.col(sources_col)).alias("pattern"))
        met = row.join(self.side(self.stretches), "pattern", "left")
        key = F.col("_row")[key_col]

        def copies(s: Column) -> Column:
            ends = s["turn_to"] + (key < s["key_to"]).cast("int")
            return ends - s["turn_from"] - (key < s["key_from"]).cast("int")

        by = F.transform("stretches", lambda s: F.struct(s["source"].alias("source"), copies(s).alias("copies")))
        by = F.coalesce(F.filter(by, lambda x: x["copies"] > 0), F.array().cast("array<struct<source:string,copies:int>>"))
        met = met.select("_row", by.alias("_by"))
        own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("taken_by", "copies")]
        total = F.aggregate("_by", F.lit(0), lambda n, x: n + x["copies"])
        return met.select(*own, F.col("_by").alias("taken_by"), total.alias("copies"))


STRETCHES = "array<struct<source:string,turn_from:int,key_from:long,turn_to:int,key_to:long>>"


@dataclass(frozen=True)
class Level:
    """Where targets fill up to: `left` words for sources of a `weight` in all, once the capped ones have theirs."""

    left: int
    weight: int

    def capped(self, most: int) -> Column:
        """Whether a source has less than its share: most * size / weight < left / weight of all, in whole numbers."""
        whole = lambda x: x.cast("decimal(19,0)")
        return whole(F.col("size") * most) * whole(F.lit(self.weight)) < whole(F.col("weight")) * whole(F.lit(self.left))


def _level(sources: DataFrame, most: int) -> Level:
    """The level of `targets`: every round caps all sources below the level, which then rises, until none is below it."""
    sums = (F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    total = sources.agg(*sums).first()
    level = Level(int(total.size), int(total.weight))
    while True:
        below = sources.where(level.capped(most)).agg(*sums).first()
        after = Level(int(total.size) - most * int(below.size or 0), int(total.weight) - int(below.weight or 0))
        if after == level:
            return level
        level = after


def _with_quotas(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """`sources` (name, size, place, weight) with target and quota, as `targets` and `quotas` give them.

    Sources that are not capped and have one weight have one target, so the
    remainders are as few as the weights.
    """
    level = _level(sources, most)
    capped = level.capped(most)
    wanted = {w: Fraction(w * level.left, level.weight) for w in sorted(set(weights))}
    counts = {r.weight: r.n for r in sources.where(~capped).groupBy("weight").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each weight
    over = level.left - sum(n * int(wanted[w]) for w, n in counts.items())
    extra = F.lit(False)
    for part in sorted({wanted[w] - int(wanted[w]) for w in counts}, reverse=True):
        group = [w for w in counts if wanted[w] - int(wanted[w]) == part]
        mine = ~capped & F.col("weight").isin(group)
        n = sum(counts[w] for w in group)
        if over >= n:
            extra, over = extra | mine, over - n
        elif over > 0:  # the first ones of the group
            last = number_within(sources.where(mine).select("place"), [], [F.asc("place")], "turn").where(F.col("turn") == over).first()
            extra, over = extra | (mine & (F.col("place") <= last.place)), 0

    def of(value: Callable[[Fraction], float | int], kind: str) -> Column:
        return F.coalesce(*(F.when(F.col("weight") == w, F.lit(value(x)).cast(kind)) for w, x in wanted.items()))

    whole = F.col("size") * most
    return sources.withColumns(
        {
            "target": F.when(capped, whole.cast("double")).otherwise(of(float, "double")),
            "quota": F.when(capped, whole).otherwise(of(int, "long") + extra.cast("long")),
        }
    )


def _keys_beyond(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(name, key_to): for each of `cuts` (name, words) the least hash that lies beyond it, as `_places` finds it."""
    live, known = cuts.select("name", F.lit(0).cast("long").alias("stem"), "words"), 0
    for bits in (FIRST, FIRST + SECOND, KEY_BITS):
        last = bits == KEY_BITS
        bucket = F.shiftright("key", KEY_BITS - bits).alias("bucket")
        if known:  # a stem is narrow, so no source is one group
            inside = rows.withColumn("stem", F.shiftright("key", KEY_BITS - known))
            inside = inside.join(live.select("name", "stem"), ["name", "stem"], "left_semi")
        else:
            inside = rows.withColumn("stem", F.lit(0).cast("long"))
        sums = inside.groupBy("name", "stem", bucket).agg(F.sum("size").alias("size"))
        sums = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("name", "stem").orderBy("bucket")))
        beyond = F.expr("2 * upto - size > 2 * words" if last else "upto > words")
        hit = live.join(sums, ["name", "stem"]).where(beyond).groupBy("name", "stem", "words")
        hit = hit.agg(F.min("bucket").alias("bucket"), F.min(F.expr("upto - size")).alias("before"))
        if last:  # unless a hash inside lies beyond the cut, the end of the bucket does
            end = F.shiftleft(F.col("stem") + 1, KEY_BITS - known)
            return live.join(hit.select("name", "bucket"), "name", "left").select("name", F.coalesce("bucket", end).alias("key_to"))
        live = saved(hit.select("name", F.col("bucket").alias("stem"), (F.col("words") - F.col("before")).alias("words")), "cuts")
        known = bits
    raise AssertionError


def _plan_apart(rows: DataFrame, weights: Sequence[int], most: int, max_patterns: int) -> Mix:
    """The mix of `plan_mix` where no document has two sources, for any number of sources."""
    seen = saved(rows.groupBy("names").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")), "patterns")
    if seen.where(F.size("names") > 1).limit(1).collect():
        raise ValueError(f"more than {max_patterns} membership patterns of overlapping sources; merge sources or raise max_patterns")
    named = seen.where(F.size("names") == 1).select(F.col("names")[0].alias("name"), "size")
    # In the order of code points, the nameless one last: "=" comes before "n".
    placed = number_within(named, [], [F.asc("name")], "place")
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    placed = saved(placed.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long")), "sources")
    wanted = _with_quotas(placed, weights, most)
    wanted = saved(wanted.withColumns({"turn_to": F.expr("try_divide(quota - quota % nullif(size, 0), size)").cast("int"), "words": F.expr("quota % nullif(size, 0)")}), "quotas")
    single = rows.where(F.size("names") == 1).select(F.col("names")[0].alias("name"), "size", "key")
    ends = _keys_beyond(single, wanted.where("words > 0").select("name", "words"))
    source = F.when(F.col("name") != "null", F.substr("name", F.lit(2)))
    stretch = F.struct(
        source.alias("source"), F.lit(0).alias("turn_from"), F.lit(0).cast("long").alias("key_from"),
        "turn_to", F.coalesce("key_to", F.lit(0).cast("long")).alias("key_to"),
    )
    stretches = wanted.where("quota > 0").join(ends, "name", "left").select(F.array("name").alias("pattern"), F.array(stretch).cast(STRETCHES).alias("stretches"))
    return Mix(wanted.select(source.alias("source"), F.col("size").alias("source_size"), "target"), saved(stretches, "stretches"), bounded=False)


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    max_patterns: int = MAX_PATTERNS,
    sources_col: str = "sources",
    size_col: str = "size",
    key_col: str = "key",
) -> Mix:
    """Plan a mix as large as `docs`, which should be a written, narrow table (it is read four times).

    `sources_col` holds an array with the sources of a document; an empty or
    null one means that no source lists it, and it is not taken. A null element
    is a source without a name. Sources in the order of their code points, the
    nameless one last, weigh `weights`, repeating. Their shares of all sizes
    are capped at `most` times what they list. Without documents, or with
    sizes of 0 only, all targets are 0. More than `max_patterns` patterns are an
    error if a document has several sources; without such documents they give
    the same mix, which is then joined instead of broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select(_pattern(F.col(sources_col)).alias("names"), F.col(size_col).alias("size"), F.col(key_col).alias("key"))
    seen = rows.groupBy("names").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(seen) > max_patterns:
        return _plan_apart(rows, weights, most, max_patterns)
    seen = sorted((tuple(r.names), r.size or 0) for r in seen)
    names = sorted({n for pattern, _ in seen for n in pattern}, key=lambda n: (n == "null", n))
    place = {n: i for i, n in enumerate(names)}
    listed = [0] * len(names)
    for pattern, size in seen:
        for n in pattern:
            listed[place[n]] += size
    weight = [weights[i % len(weights)] for i in range(len(names))]
    wanted = targets(listed, weight, sum(size for pattern, size in seen if pattern), most)
    flow = route([size for _, size in seen], [[place[n] for n in p] for p, _ in seen], quotas(wanted), most)

    stretches: dict[int, list[tuple[int, Cut, Cut]]] = {}
    reached = [0] * len(seen)
    for (p, s), words in sorted(flow.items()):
        size = seen[p][1]
        a, b = (Cut(p, *divmod(o, size)) for o in (reached[p], reached[p] + words))
        stretches.setdefault(p, []).append((s, a, b))
        reached[p] += words
    cuts = sorted({c for x in stretches.values() for _, a, b in x for c in (a, b)}, key=lambda c: (c.pattern, c.turn, c.words))
    ids = spark.createDataFrame([(i, list(p)) for i, (p, _) in enumerate(seen)], "pattern int, names array<string>")
    at = _places(rows.join(F.broadcast(ids), "names").select("pattern", "key", "size"), cuts)  # at most max_patterns rows

    plain = [None if n == "null" else n[1:] for n in names]
    table = [
        (list(seen[p][0]), [(plain[s], a.turn, at[a], b.turn, at[b]) for s, a, b in x]) for p, x in stretches.items()
    ]
    return Mix(
        spark.createDataFrame(
            [(n, listed[i], float(wanted[i])) for i, n in enumerate(plain)], "source string, source_size long, target double"
        ),
        spark.createDataFrame(table, f"pattern array<string>, stretches {STRETCHES}"),
    )


def measured(docs: DataFrame, seed: int, *columns: str | Column) -> DataFrame:
    """`columns` of documents with sources (their one source), size (words) and key (seeded order)."""
    extra = {
        "sources": F.array("source"),
        "size": word_count(F.col("text")),
        "key": seeded_key(F.col("doc_id"), F.col("text"), seed),
    }
    return docs.select(*columns, *(c.alias(n) for n, c in extra.items()))
