"""Column expressions shared by the reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once for each row, however often `use` names it.

    A plain name is only a copy of its expression, and the optimizer copies a
    projected column into the next projection too where fields are taken from
    it. What a lambda is given is a value.
    """
    return F.transform(F.array(value), use)[0]


def average(column: str) -> Column:
    """Mean as double; null when nothing is counted."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column))


def exact_average(total: Column, n: Column) -> Column:
    """Mean of a decimal sum, kept as decimal so that later rounding sees the exact value."""
    return F.try_divide(total, n)


def half_up(value: Column, digits: int) -> Column:
    return F.round(value, digits).cast("double")


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits).cast("double")


def round_float(value: Column, digits: int) -> Column:
    """Round a non-negative double by its exact binary value, ties to even.

    Spark rounds the printed decimal, so 0.35 (stored a little below) becomes
    0.4 there and 0.3 here. `2 * 10**digits * value` is formed as an exact sum
    of two doubles and compared with the odd number half-way between the two
    candidates.
    """
    scale = float(10**digits)
    # Splitting the value into two halves makes both products exact.
    high = value * 134217729.0 - (value * 134217729.0 - value)
    a, b = high * (2 * scale), (value - high) * (2 * scale)
    total = a + b
    below = F.floor(value * scale).cast("double")
    side = (total - (below * 2 + 1)) + (b - (total - a))
    up = (side > 0) | ((side == 0) & (below % 2 == 1))
    return (below + F.when(up, 1.0).otherwise(0.0)) / scale


def share_percent(part: Column, whole: Column) -> Column:
    """`part` of `whole` in percent; null when `whole` is 0."""
    return F.try_divide(part.cast("double"), whole) * 100


def score_band(score: Column) -> Column:
    # Band limits.
    return (
        F.when(score >= 90, "excellent")
        .when(score >= 70, "good")
        .when(score >= 60, "pass")
        .when(score.isNotNull(), "fail")
    )


def score_tier(score: Column) -> Column:
    # Tier limits.
    return (
        F.when(score == 100, "success")
        .when(score >= 70, "warning")
        .when(score.isNotNull(), "danger")
    )


def pass_rate_tier(rate: Column) -> Column:
    # Tier limits.
    return F.when(rate >= 70, "success").when(rate >= 50, "warning").otherwise("danger")


def first_words(text: Column, n: int) -> Column:
    """The first `n` words, with an ellipsis when some are left out."""
    words = F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    cut = F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(" …"))
    return F.when(F.size(words) > n, cut).otherwise(F.array_join(words, " "))


def first_chars(text: Column, n: int = 50) -> Column:
    return F.substring(text, 1, n)


def display_date(time: Column, month: str = "MMM.", with_time: bool = False) -> Column:
    """`Mar. 05, 2024`, or with time `Mar. 05, 2024, 4:07 p.m.`; `MMMM` spells the month out."""
    day = F.date_format(time, f"{month} dd, yyyy")
    if not with_time:
        return day
    half = F.when(F.hour(time) < 12, "a.m.").otherwise("p.m.")
    return F.concat_ws(" ", F.concat(day, F.date_format(time, ", h:mm")), half)


def topic_line(topics: Column) -> Column:
    """A set of topics as one line in byte order."""
    return F.array_join(F.sort_array(topics), ",")
