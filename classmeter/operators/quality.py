"""Row rules, key and reference checks, and text gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from classmeter.functions.sqltext import strip
from classmeter.sources.schemas import (
    KEYS, MAX_LENGTH, NOT_BLANK, REFERENCES, REQUIRED, UNIQUE, VOCABULARY,
)
from classmeter.session import written
from classmeter.sources.tables import Tables


def split_by(df: DataFrame, broken: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason); a rule that is unknown for a row passes it."""
    broken = F.coalesce(broken, F.lit(False))
    return df.filter(~broken), df.filter(broken).withColumn("reason", F.lit(reason))


def feedback_missing() -> Column:
    """A reviewer without a text. An empty text is a text."""
    return F.col("mentor_id").isNotNull() & F.col("feedback").isNull()


def score_outside() -> Column:
    return ~F.col("score").between(0, 100)


def feedback_rule(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_by(df, feedback_missing(), "feedback required")


def score_range_rule(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_by(df, score_outside(), "score out of range")


def key_uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter("n_rows > 1")


def all_keys(t: Tables) -> DataFrame:
    """Repeated primary and unique keys of all relations."""
    checks = [(name, keys) for name, keys in KEYS.items()]
    checks += [(name, keys) for name, keys in UNIQUE.items()]

    def report(relation: str, keys: tuple[str, ...]) -> DataFrame:
        parts = [F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]
        return key_uniqueness(t[relation], list(keys)).select(
            F.lit(relation).alias("relation"),
            F.lit(",".join(keys)).alias("key"),
            F.concat_ws(",", *parts).alias("value"),
            "n_rows",
        )

    return reduce(DataFrame.union, [report(*check) for check in checks])


def vocabulary_rule(df: DataFrame, relation: str) -> DataFrame:
    """Values outside the allowed ones, with their row counts; null passes."""

    def report(column: str, allowed: tuple[str, ...]) -> DataFrame:
        wrong = df.filter(~F.col(column).isin(*allowed))
        counts = wrong.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
        return counts.select(
            F.lit(relation).alias("relation"), F.lit(column).alias("column"), "value", "n_rows"
        )

    return reduce(DataFrame.union, [report(*rule) for rule in VOCABULARY[relation].items()])


# The relations that are referred to, with their key.
PARENTS = list(dict.fromkeys((edge[2], edge[3]) for edge in REFERENCES))


def _marked(t: Tables, parent: str, key: str, column: str) -> list[Column]:
    """A key as block, word and bits: a whole number is one bit in the block of 64 that it lies in, another key a word."""
    value = F.col(column)
    if not isinstance(t[parent].schema[key].dataType, T.IntegralType):
        bits = F.when(value.isNotNull(), F.lit(1).cast("long"))
        return [F.lit(0).cast("long").alias("block"), value.alias("word"), bits.alias("bits")]
    value = value.cast("long")
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), value.bitwiseAND(63).cast("int"))
    return [F.shiftright(value, 6).alias("block"), F.lit("").alias("word"), bits.alias("bits")]


def reference_blocks(t: Tables, child: str) -> DataFrame:
    """(edge, parent, block, word, bits) of all references of a relation, in one pass over it.

    `edge` and `parent` are places in REFERENCES and PARENTS. Keys are put
    together in the map tasks, up to 64 of them in a row, so a hot parent is
    one bit for each task and near ids travel together.
    """
    edges = [(n, edge[1], edge[2:4]) for n, edge in enumerate(REFERENCES) if edge[0] == child]
    refs = [
        F.struct(F.lit(n).alias("edge"), F.lit(PARENTS.index(of)).alias("parent"), *_marked(t, *of, column))
        for n, column, of in edges
    ]
    held = t[child].select(F.inline(F.array(*refs))).filter("bits is not null")
    return held.groupBy("edge", "parent", "block", "word").agg(F.bit_or("bits").alias("bits"))


def broken_references(t: Tables) -> DataFrame:
    """(edge, key, word): every different reference that its parent does not hold, written.

    Each child is read once, and each parent once. Blocks of references meet
    blocks of keys; what is left of a block once the parent's bits are taken
    away is exactly the broken keys, so nothing has to be looked up again.
    """
    children = dict.fromkeys(edge[0] for edge in REFERENCES)
    used = reduce(DataFrame.union, [reference_blocks(t, child) for child in children])
    keys = [
        t[parent].select(F.lit(n).alias("parent"), *_marked(t, parent, key, key)).filter("bits is not null")
        for n, (parent, key) in enumerate(PARENTS)
    ]
    there = ["parent", "block", "word"]
    held = reduce(DataFrame.union, [k.groupBy(*there).agg(F.bit_or("bits").alias("held")) for k in keys])
    lost = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("long"))))
    missing = used.join(held, there, "left").withColumn("lost", lost).filter("lost <> 0")
    bit = F.explode(F.expr("filter(sequence(0, 63), i -> getbit(lost, i) = 1)"))
    missing = missing.select("edge", "block", "word", bit.alias("bit"))
    key = F.shiftleft("block", 6).bitwiseOR(F.col("bit").cast("long"))
    return written(missing.select("edge", key.alias("key"), "word"), "broken-references")


def orphan_check(t: Tables) -> DataFrame:
    """All broken references of all relations: (child, column, parent, missing_key, n_rows).

    A child is read a second time only if it holds broken references, to count
    their rows; only rows that hold one are shuffled.
    """
    broken = broken_references(t)
    edges = sorted(row.edge for row in broken.select("edge").distinct().collect())  # a row for each reference at most
    same = ["edge", "key", "word"]
    counts = []
    for child in dict.fromkeys(REFERENCES[n][0] for n in edges):
        refs = []
        for n in (n for n in edges if REFERENCES[n][0] == child):
            _, column, parent, key, _ = REFERENCES[n]
            whole = isinstance(t[parent].schema[key].dataType, T.IntegralType)
            value, zero = F.col(column), F.lit(0).cast("long")
            parts = (value.cast("long"), F.lit("")) if whole else (zero, value)
            text = value.cast("string").alias("missing_key")
            refs.append(F.struct(F.lit(n).alias("edge"), *(x.alias(c) for x, c in zip(parts, same[1:])), text))
        rows = t[child].select(F.inline(F.array(*refs))).filter("missing_key is not null")
        hit = rows.join(broken, same, "left_semi").groupBy("edge", "missing_key").agg(F.count(F.lit(1)).alias("n_rows"))
        counts.append(hit)
    if not counts:
        return broken.sparkSession.createDataFrame(
            [], "child string, column string, parent string, missing_key string, n_rows long"
        )
    name = lambda place: F.get(F.array(*(F.lit(edge[place]) for edge in REFERENCES)), F.col("edge"))
    return reduce(DataFrame.union, counts).select(
        name(0).alias("child"), name(1).alias("column"), name(2).alias("parent"), "missing_key", "n_rows"
    )


def _near(snapshot: DataFrame, column: str, keys: DataFrame, of: str) -> DataFrame:
    """The rows of `snapshot` whose `column` lies within the range of `keys`.`of`.

    The bounds are literals, so they reach the scan, which skips what holds
    other keys. Nulls stay if the keys hold one.
    """
    span = keys.agg(F.min(of).alias("low"), F.max(of).alias("high"), F.count_if(F.col(of).isNull()).alias("nulls")).first()
    near = F.lit(False) if span.low is None else F.col(column).between(F.lit(span.low), F.lit(span.high))
    return snapshot.filter(near | F.col(column).isNull() if span.nulls else near)


def delta_keys(t: Tables, deltas: dict[str, DataFrame]) -> DataFrame:
    """Primary and unique keys that new rows would repeat: (relation, key, value, n_new, n_held).

    `deltas` holds new rows by relation. `n_new` rows of the delta and `n_held`
    of the snapshot have the key. The keys of the delta are written once and
    sent to the snapshot's rows in their range; only what meets them is
    counted. As in `all_keys`, a null is a value.
    """
    checks = [(name, keys) for rules in (KEYS, UNIQUE) for name, keys in rules.items() if name in deltas]

    def report(relation: str, keys: tuple[str, ...]) -> DataFrame:
        new = deltas[relation].groupBy(*keys).agg(F.count(F.lit(1)).alias("n_new"))
        new = written(new, f"new-keys-{relation}").alias("new")
        same = lambda side: reduce(Column.__and__, [F.col(f"{side}.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
        near = _near(t[relation].select(*keys), keys[0], new, keys[0]).alias("old")
        held = near.join(new, same("old"), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_held"))
        n_held = F.coalesce("n_held", F.lit(0)).cast("long")
        parts = [F.coalesce(F.col(f"new.{k}").cast("string"), F.lit("null")) for k in keys]
        return new.join(held.alias("held"), same("held"), "left").filter(F.col("n_new") + n_held > 1).select(
            F.lit(relation).alias("relation"),
            F.lit(",".join(keys)).alias("key"),
            F.concat_ws(",", *parts).alias("value"),
            "n_new",
            n_held.alias("n_held"),
        )

    return reduce(DataFrame.union, [report(*check) for check in checks])


def delta_orphans(t: Tables, deltas: dict[str, DataFrame]) -> DataFrame:
    """References of new rows that neither the snapshot nor the deltas hold, as `orphan_check` gives them.

    The different references of a column are written once and sent to the
    parent's rows in their range; the parent itself is not shuffled while they
    are small.
    """

    def report(child: str, column: str, parent: str, key: str) -> DataFrame:
        used = deltas[child].filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key"))
        used = written(used.agg(F.count(F.lit(1)).alias("n_rows")), f"references-{child}-{column}")
        held = _near(t[parent].select(F.col(key).alias("_key")), "_key", used, "_key")
        if parent in deltas:
            held = held.union(deltas[parent].select(F.col(key).alias("_key")))
        found = held.join(used, "_key", "left_semi").distinct()
        return used.join(found, "_key", "left_anti").select(
            F.lit(child).alias("child"),
            F.lit(column).alias("column"),
            F.lit(parent).alias("parent"),
            F.col("_key").cast("string").alias("missing_key"),
            "n_rows",
        )

    edges = [edge[:4] for edge in REFERENCES if edge[0] in deltas]
    if not edges:
        raise ValueError(f"no references in {sorted(deltas)}")
    return reduce(DataFrame.union, [report(*edge) for edge in edges])


def required_and_length(df: DataFrame, relation: str) -> DataFrame:
    """One row per broken column rule: the row's key, the column, what is wrong."""
    broken: list[Column] = []

    def rule(column: str, kind: str, wrong: Column) -> None:
        found = F.struct(F.lit(column).alias("column"), F.lit(kind).alias("violation"))
        broken.append(F.when(wrong, found))

    present = set(df.columns)
    for column in REQUIRED.get(relation, ()):
        if column in present:
            rule(column, "missing", F.col(column).isNull())
    for column in NOT_BLANK.get(relation, ()):
        if column in present:
            rule(column, "blank", F.col(column).isNotNull() & (strip(F.col(column)) == ""))
    for column, longest in MAX_LENGTH.get(relation, {}).items():
        if column in present:
            rule(column, "too long", F.length(column) > longest)
    keys = [k for k in KEYS[relation] if k in present]
    found = df.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("_v"))
    return found.select(*keys, "_v.column", "_v.violation")


# Words a read-only query must not contain.
WRITE_WORDS = ("insert", "update", "delete", "drop", "alter", "truncate", "create")


def read_only_gate(df: DataFrame, column: str, mode: str = "substring") -> DataFrame:
    """Add `accepted` and `reason`.

    `substring` refuses a write word anywhere, so also `created_at`; `word`
    refuses it only as a word of its own.
    """
    edge = r"\b" if mode == "word" else ""
    words = f"{edge}(?:{'|'.join(WRITE_WORDS)}){edge}"
    lowered = F.lower(strip(F.coalesce(column, F.lit(""))))
    reason = F.when(~F.startswith(lowered, F.lit("select")), "not a select").when(
        F.regexp_like(lowered, F.lit(words)), "write word"
    )
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def meaningful_text(df: DataFrame, column: str) -> DataFrame:
    """Add `meaningful`: at least 10 characters after stripping, 3 of them letters or digits."""
    text = strip(F.coalesce(column, F.lit("")))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return df.withColumn("meaningful", (F.length(text) >= 10) & (letters >= 3))


def parse_answer(df: DataFrame, column: str) -> DataFrame:
    """SQL text and explanation out of a generated JSON answer; missing ones are empty."""
    answer = F.from_json(column, "sql string, explanation string")
    part = lambda name: strip(F.coalesce(answer[name], F.lit("")))
    return df.withColumns({"sql": part("sql"), "explanation": part("explanation")})


GENERATED = "problems array<struct<title string, description string, correct_sql string, topics array<string>>>"


def difficulty_of(column: Column) -> Column:
    """Capitalised when that gives a known level, else Easy."""
    word = F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substring(column, 2, 2**31 - 1)))
    known = VOCABULARY["problem"]["difficulty"]
    return F.when(word.isin(*known), word).otherwise("Easy")


def parse_generated(
    df: DataFrame, column: str, difficulty: Column, keys: list[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(problems, their topics, refused payloads) out of generated JSON lists.

    A payload without a non-empty list of problems is refused. Problems
    without title or SQL are left out; `position` counts from 0 in the list.
    """
    listed = F.from_json(column, GENERATED)["problems"]
    read = df.withColumn("_listed", listed).withColumn("difficulty", difficulty_of(difficulty))
    usable = F.coalesce(F.size("_listed") > 0, F.lit(False))
    refused = read.filter(~usable).select(*keys)
    items = read.filter(usable).select(
        *keys, "difficulty", F.posexplode("_listed").alias("position", "_item")
    )
    field = lambda name: strip(F.coalesce(F.col(f"_item.{name}"), F.lit("")))
    items = items.select(
        *keys,
        "position",
        "difficulty",
        field("title").alias("_title"),
        F.nullif(field("description"), F.lit("")).alias("description"),
        field("correct_sql").alias("correct_answer"),
        F.col("_item.topics").alias("_topics"),
    ).filter("_title <> '' and correct_answer <> ''")
    # Title and topic lengths.
    short = F.when(F.length("_title") > 200, F.concat(F.substring("_title", 1, 197), F.lit("...")))
    problems = items.select(
        *keys,
        "position",
        F.coalesce(short, F.col("_title")).alias("title"),
        "description",
        "correct_answer",
        "difficulty",
    )
    names = F.filter(
        F.transform("_topics", lambda name: strip(F.substring(name, 1, 100))),
        lambda name: name != "",
    )
    topics = items.select(
        *keys, "position", F.explode(F.array_distinct(names)).alias("topic_name")
    )
    return problems, topics, refused
