"""Personal data: fixed patterns, and what a bootstrap over contexts adds to them.

Base spans are e-mail addresses, IP addresses, card and telephone numbers by
fixed patterns. They seed a bootstrap. Identifier-like runs of all texts are
instances, known by their normal form; the words around them are lexical
patterns, each for one kind. In the graph of patterns and instances, a round
scores a pattern by the share of its instances that are of its kind, and an
instance by the believed patterns it stands in (1 minus the product of their doubts).
Seeds keep their scores: 1 for their own kind, 0 for others. Instances that
stand at or above `least` after the last round are unseen identifiers, and every
place of theirs becomes a span; so does a seed's that is written in another way.

All steps are DataFrame and SQL functions. Edges are different (pattern,
instance) pairs, pre-aggregated in the map tasks, so that a repeated text or a
frequent identifier counts once; scores are joined and summed, and written in
each round. Nothing is collected, and no pattern or instance is left out but by
the stated thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from classmeter.llm.common import saved

# Fixed by the contract: kinds in order, their patterns and checks. Possessive, and only tried where a
# match can begin, which gives the same matches without going back over long runs.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
# An identifier-like run: no blanks but between digits and brackets, and a digit or @ in it.
RUN = r"(?<![A-Za-z._%+()-])[A-Za-z._%+()-]*+[0-9@](?:[A-Za-z0-9._%+@()-]|(?<=[0-9().-])\x20++(?=[0-9().-]))*+"
# Characters on either side that context words are taken from; matches whose places are summed in one go.
BESIDE, TOGETHER = 60, 256
# Rounds; different instances that a pattern needs; score from which a pattern is believed, and an instance taken.
ROUNDS, MIN_INSTANCES, LEAST = 3, 3, 0.8


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    reverse = F.reverse(F.transform(F.split(digits, ""), lambda d: d.cast("int")))
    doubled = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    """The check that a match of a kind has to pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}\z")
    n = F.char_length(_digits(found))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(_digits(found))).otherwise(False)


def _running(lengths: Column) -> Column:
    """The sums before each of `lengths`. Sums of TOGETHER numbers first, as an array that grows is copied each time."""
    blocks = F.ceil(F.size(lengths) / F.lit(TOGETHER)).cast("int")
    places = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    add = lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n))
    sums = F.transform(places, lambda b: F.aggregate(F.slice(lengths, b * TOGETHER + 1, TOGETHER), F.lit(0), lambda a, n: a + n))
    before = F.slice(F.aggregate(sums, F.array(F.lit(0)), add), 1, blocks)
    inside = lambda b, start: F.aggregate(F.slice(lengths, b * TOGETHER + 1, TOGETHER - 1), F.array(start), add)
    return F.slice(F.flatten(F.zip_with(places, before, inside)), 1, F.size(lengths))


def _with_matches(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """`rows` with the matches of a pattern in `found`, what lies before, between and after them in `between`, and
    where they begin (from 0, in code points) in `starts`. Functions over an array see its elements only: an
    array named inside of one may be worked out again for each element."""
    rows = rows.withColumns({"found": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "between": F.split(text, pattern, -1)})
    rows = rows.withColumn("before", F.transform(F.slice("between", 1, F.size("found")), F.char_length))
    rows = rows.withColumn("lengths", F.zip_with("found", "before", lambda m, n: F.char_length(m) + n))
    starts = F.zip_with(_running(F.col("lengths")), "before", lambda done, n: done + n)
    return rows.withColumn("starts", starts).drop("lengths", "before")


def base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """`rows` with `base`: (kind, start, end) of each base span, by kind and start."""
    for kind in KINDS:
        rows = _with_matches(rows, text, PATTERNS[kind])
        span = lambda m, at: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.char_length(m)).alias("end"), passes(kind, m).alias("passes"))
        kept = F.filter(F.zip_with("found", "starts", span), lambda s: s["passes"])
        plain = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        rows = rows.withColumn(f"base_{kind}", plain).drop("found", "between", "starts")
    return rows.withColumn("base", F.concat(*(f"base_{k}" for k in KINDS))).drop(*(f"base_{k}" for k in KINDS))


def _edge(text: Column) -> tuple[Column, Column]:
    """What a run begins and ends with that is no part of an identifier."""
    return F.regexp_extract(text, r"^[._%)-]*+", 0), F.regexp_extract(text, r"(?<![._%+(-])[._%+(-]+\z", 0)


def kind_of(run: Column) -> Column:
    """The kind of base span that lies in a run, or null; the first by order if there are several."""
    def holds(kind: str) -> Column:
        return F.exists(F.regexp_extract_all(run, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: passes(kind, m))

    found = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        found = F.when(holds(kind), F.lit(kind)).otherwise(found)
    return found


def may_be(run: Column) -> Column:
    """The kinds whose form a run could have, however loosely."""
    n = F.char_length(_digits(run))
    plain = ~run.rlike("[A-Za-z@%]")
    forms = {
        "email": run.rlike(r"^[^@]+@[^@]+\z") & run.rlike("[A-Za-z]"),
        "ip": plain & run.rlike(r"^[0-9]+(\.[0-9]+){3}\z"),
        "card": plain & n.between(12, 19),
        "phone": plain & n.between(7, 15),
    }
    return F.filter(F.array(*(F.when(f, F.lit(k)) for k, f in forms.items())), lambda k: k.isNotNull())


def _words(text: Column) -> Column:
    """Context words: cut at blanks, in lower case, digits as 0."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"\s+"), lambda w: w != "")


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_id, start, end, instance, kind, kinds, contexts) for each identifier-like run of each different text.

    `text_id` is the SHA-256 of the text, `instance` the run in lower case, a run
    without letters only its digits; `kind` that of the base span in it, `kinds` the
    forms it could have. `contexts` are the two words before it, the words around
    it, and the word before it, up to the next run or BESIDE characters away.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("text").rlike("[0-9@]"))
    rows = _with_matches(rows, "text", RUN).where(F.size("found") > 0)
    beside = lambda first, side: F.transform(F.slice("between", first, F.size("found")), lambda x: side(x, F.lit(BESIDE)))
    zipped = F.arrays_zip(F.col("starts").alias("start"), F.col("found").alias("run"), beside(1, F.right).alias("left"), beside(2, F.left).alias("right"))
    each = rows.select(F.unhex(F.sha2("text", 256)).alias("text_id"), F.inline(zipped).alias("start", "run", "left", "right"))
    head, tail = _edge(F.col("run"))
    each = each.withColumns({"head": head, "tail": tail})
    run = F.expr("substring(run, char_length(head) + 1, greatest(char_length(run) - char_length(head) - char_length(tail), 0))")
    each = each.withColumn("run", run).where("run <> ''")
    each = each.withColumns({"start": F.col("start") + F.char_length("head"), "before": F.slice(F.reverse(_words(F.col("left"))), 1, 2), "after": F.get(_words(F.col("right")), 0)})
    first = F.coalesce(F.get("before", 0), F.lit("^"))
    contexts = F.array(
        F.concat_ws(" ", F.coalesce(F.get("before", 1), F.lit("^")), first, F.lit("_")),
        F.concat_ws(" ", first, F.lit("_"), F.coalesce("after", F.lit("$"))),
        F.concat_ws(" ", first, F.lit("_")),
    )
    plain = ~F.col("run").rlike("[A-Za-z@%]")
    instance = F.when(plain & ~F.col("run").rlike(r"^[0-9]+(\.[0-9]+){3}\z"), _digits(F.col("run"))).otherwise(F.lower("run"))
    return each.select(
        "text_id", "start", (F.col("start") + F.char_length("run")).alias("end"), instance.alias("instance"),
        kind_of(F.col("run")).alias("kind"), may_be(F.col("run")).alias("kinds"), contexts.alias("contexts"),
    )


def bootstrap(found: DataFrame, rounds: int = ROUNDS, min_instances: int = MIN_INSTANCES, least: float = LEAST) -> DataFrame:
    """(instance, kind, score) for the seeds, which score 1, and the unseen instances that score `least` or more;
    of several kinds the best, ties by name.

    `found` are occurrences. An instance that anywhere holds a base span is a seed
    of that kind (the first by name if of several). A pattern is a context for one
    of the kinds that its seeds have, with `min_instances` different instances.
    """
    seen = found.select("instance", "kind", "kinds", F.explode("contexts").alias("context"))
    edges = seen.groupBy("context", "instance").agg(F.min("kind").alias("kind"), F.max("kinds").alias("kinds"))
    kinds = saved(edges.groupBy("instance").agg(F.min("kind").alias("seed")), "instances")
    sizes = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.collect_set("kind").alias("pattern_kinds"))
    sizes = saved(sizes.where((F.col("n") >= min_instances) & (F.size("pattern_kinds") > 0)), "contexts")
    edges = saved(edges.drop("kind").join(sizes, "context").join(kinds, "instance"), "context-edges")
    # An instance under each kind of the pattern: a seed scores 1 or 0 for good, another if its form allows the kind.
    graph = edges.select("context", "instance", "seed", "kinds", F.explode("pattern_kinds").alias("kind"))
    open_ = F.col("seed").isNull() & F.array_contains("kinds", F.col("kind"))
    graph = saved(graph.select("context", "instance", "kind", (F.col("seed") == F.col("kind")).alias("is_seed"), open_.alias("open")), "context-graph")
    scores = None
    for turn in range(rounds):
        scored = graph.withColumn("score", F.when(F.col("is_seed"), 1.0).otherwise(0.0))
        if scores is not None:
            scored = graph.join(scores, ["instance", "kind"], "left")
            scored = scored.withColumn("score", F.when(F.col("is_seed"), 1.0).when(F.col("open"), F.coalesce("score", F.lit(0.0))).otherwise(0.0))
        # An instance that could be of the kind and has no score yet counts half as much as one that is not.
        weight = F.when(F.col("open"), 0.5 + 0.5 * F.col("score")).otherwise(1.0)
        patterns = scored.groupBy("context", "kind").agg(F.round(F.sum("score") / (F.sum(weight) + 1), 9).alias("belief"))
        patterns = saved(patterns.where(F.col("belief") > 0), f"patterns-{turn}")
        doubt = F.sum(F.log1p(-F.col("belief")))
        met = graph.where("open").join(patterns, ["context", "kind"])
        # Only patterns that are believed speak for an instance.
        scores = met.where(F.col("belief") >= least).groupBy("instance", "kind").agg(F.round(1 - F.exp(doubt), 9).alias("score"))
        scores = saved(scores, f"instances-{turn}")
    best = scores.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best"))
    best = best.where(F.col("best.score") >= least).select("instance", "best.kind", "best.score")
    return kinds.where("seed IS NOT NULL").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).union(best)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_instances: int = MIN_INSTANCES, least: float = LEAST) -> DataFrame:
    """One row per row of `docs`: its id, `base` and `spans`, arrays of (kind, start, end) by kind and start.

    Places are in code points, the end is exclusive. A null text counts as empty
    and has no spans; null ids and repeated rows stay. A document shows what was
    learned from all; without a believed pattern `spans` is `base`. Added spans
    overlap no base span. Other columns are not read.
    """
    found = saved(occurrences(docs, text_col), "identifier-runs")
    known = bootstrap(found, rounds, min_instances, least).withColumnRenamed("kind", "as_kind")
    # Seeds that are written in another way here, and unseen identifiers.
    added = found.where("kind IS NULL").join(known, "instance").where(F.array_contains("kinds", F.col("as_kind")))
    added = added.groupBy("text_id").agg(F.collect_set(F.struct(F.col("as_kind").alias("kind"), "start", "end")).alias("added"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_id", F.unhex(F.sha2("text", 256)))
    # No kind is without a digit or @, so other texts need no search.
    rows = base_spans(rows.withColumn("text", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).otherwise(""))).drop("text")
    rows = rows.join(saved(added, "identifiers-added"), "text_id", "left")
    free = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    order = F.array(*(F.lit(k) for k in KINDS))
    ranked = F.array_sort(F.transform(F.concat("base", free), lambda s: F.struct(F.array_position(order, s["kind"]).alias("place"), s["start"].alias("start"), s.alias("span"))))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.transform(ranked, lambda s: s["span"]))
    return rows.select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
