"""Column functions that take a submitted SQL text apart and compare it with the right one.

They look at text only: the first `from`, the first `where`, commas and `and`.
Nothing is parsed or run, and all of it stays in built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from classmeter.functions.exprs import once

# Patterns of the scoring rules. Blanks are all Unicode white
# space, and the four separator controls that are white space in Python only.
BLANK = r"[\s\x1c-\x1f]"
# A run of blanks other than a single space.
UNEVEN = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*+| [\s\x1c-\x1f]++"
# A run that holds no two spaces side by side holds one of these; cheaper to look for.
UNPLAIN = r"[^ -~]"
COMMENT = r"--[^\n]*"
LAST_SEMICOLON = rf"(?U);{BLANK}*\z"
# These two meet normalised text only, where a blank is a space.
ALIAS = r"(?iU) +as +[\p{L}\p{N}_]+\z"
NAMED_TABLE = r"(?<![\p{L}\p{N}_])(?:from|join) +([a-z_][a-z0-9_]*)"
WEIGHTS = {"from": 40, "select": 30, "where": 30}


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, UNEVEN, " ")


def normalize_sql_text(text: Column) -> Column:
    """Lower-case, single-spaced, without line comments and one final semicolon.

    The semicolon goes before the comments do, so one that is followed by a
    comment stays. Block comments stay.

    A pattern is tried only where the given text holds what it needs; no step
    brings in what a later one looks for.
    """
    given = F.coalesce(text, F.lit(""))
    whole = F.when(given.contains(";"), F.regexp_replace(given, LAST_SEMICOLON, "")).otherwise(given)
    whole = F.when(given.contains("--"), F.regexp_replace(whole, COMMENT, "")).otherwise(whole)
    whole = F.when(given.contains("  ") | given.rlike(UNPLAIN), one_space(whole)).otherwise(whole)
    return F.trim(F.lower(whole))


def split_clauses(text: Column) -> Column:
    return once(normalize_sql_text(text), clauses_of)


def clauses_of(normal: Column) -> Column:
    """Struct of the select, from and where parts of a normalised text.

    A text that is not `select ... from ...` is all select part. What follows
    the first where, GROUP BY and ORDER BY included, belongs to the where part.
    """
    listed = F.substring(normal, len("select ") + 1, 2**31 - 1)
    chosen = F.substring_index(listed, " from ", 1)
    rest = _after(listed, chosen, " from ")
    source = F.substring_index(rest, " where ", 1)
    is_query = F.startswith(normal, F.lit("select ")) & listed.contains(" from ")
    return F.struct(
        F.when(is_query, chosen).otherwise(normal).alias("select"),
        F.when(is_query, source).otherwise("").alias("from"),
        F.when(is_query, _after(rest, source, " where ")).otherwise("").alias("where"),
    )


def _after(text: Column, first: Column, mark: str) -> Column:
    """What follows the mark behind `first`; empty if `first` is the whole text."""
    return F.substring(text, F.length(first) + len(mark) + 1, F.lit(2**31 - 1))


def _pieces(text: Column, mark: str) -> Column:
    """Trimmed, non-empty parts between the marks; most texts hold no mark and are one part."""
    several = F.filter(F.transform(F.split(text, mark), lambda piece: F.trim(piece)), lambda piece: piece != "")
    one = F.when(F.trim(text) != "", F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))
    return F.when(text.contains(mark), several).otherwise(one)


def _even(text: Column) -> Column:
    """Single-spaced without blanks at the ends, so that no piece between marks needs to be trimmed."""
    return ~(text.contains("  ") | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")))


def _plain_pieces(text: Column, mark: str) -> Column:
    """As `_pieces` of an even text, without a lambda, which Spark would interpret for each piece."""
    return F.array_remove(F.split(text, mark), "")


def _as_set(items: Column) -> Column:
    return F.sort_array(F.array_distinct(items))


def extract_tables(source: Column) -> Column:
    """Tables of a normalised from part.

    Names after a join; only without any, the first word of each comma part.
    """
    is_named = (source.contains("join ") | source.contains("from ")) & source.rlike(NAMED_TABLE)
    named = F.regexp_extract_all(source, F.lit(NAMED_TABLE), 1)
    several = F.transform(_pieces(source, ","), lambda piece: F.substring_index(piece, " ", 1))
    one = F.array_remove(F.array(F.substring_index(F.trim(source), " ", 1)), "")
    single = F.when(~source.contains(","), one).otherwise(several)
    return _as_set(F.when(is_named, named).otherwise(single))


def extract_columns(listed: Column) -> Column:
    """Columns of a normalised select part.

    Comma items; with parentheses as they are, else the bare column name.
    """

    def name(item: Column) -> Column:
        bare = F.when(item.contains("`"), F.translate(item, "`", "")).otherwise(item)
        bare = F.when(bare.contains(" as "), F.regexp_replace(bare, ALIAS, "")).otherwise(bare)
        return F.trim(F.substring_index(bare, ".", -1))

    def column(item: Column) -> Column:
        called = item.contains("(") | item.contains(")")
        return F.when(called, item).otherwise(name(item))

    marked = [listed.contains(mark) for mark in ("(", ")", "`", " as ", ".")]
    bare = _even(listed) & ~reduce(Column.__or__, marked)
    return _as_set(F.when(bare, _plain_pieces(listed, " ?, ?")).otherwise(F.transform(_pieces(listed, ","), column)))


def _unwrap(condition: Column) -> Column:
    """Without the parentheses around the whole; as many as stand at both ends."""
    opened = F.length(F.translate(F.regexp_extract(condition, r"\A[( ]*", 0), " ", ""))
    closed = F.length(F.translate(F.regexp_extract(condition, r"[) ]*\z", 0), " ", ""))
    peel = lambda text, _: F.trim(text.substr(F.lit(2), F.length(text) - 2))
    peeled = F.aggregate(F.array_repeat(F.lit(0), F.least(opened, closed)), condition, peel)
    wrapped = F.startswith(condition, F.lit("(")) & F.endswith(condition, F.lit(")"))
    return F.when(wrapped, peeled).otherwise(condition)


def extract_conditions(condition: Column) -> Column:
    """Conditions of a normalised where part.

    Parts between ` and `, also inside a BETWEEN, without their outer parentheses.
    """
    parts = F.filter(F.transform(_pieces(condition, " and "), _unwrap), lambda part: part != "")
    bare = _even(condition) & ~condition.contains("(")
    return _as_set(F.when(bare, _plain_pieces(condition, " and ")).otherwise(parts))


def hits(correct: Column, submitted: Column) -> Column:
    return F.size(F.array_intersect(correct, submitted))


def f1_of(both: Column, correct: Column, submitted: Column) -> Column:
    """F1 from the sizes of two sets and of what they share.

    Nothing expected is a full match, nothing given or shared none.
    """
    precision = F.try_divide(both.cast("double"), submitted)
    recall = F.try_divide(both.cast("double"), correct)
    f1 = F.try_divide(F.lit(2.0) * precision * recall, precision + recall)
    return F.when(correct == 0, 1.0).when(both == 0, 0.0).otherwise(f1)


def set_f1(correct: Column, submitted: Column) -> Column:
    return f1_of(hits(correct, submitted), F.size(correct), F.size(submitted))
