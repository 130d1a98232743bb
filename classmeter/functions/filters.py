"""Row predicates shared by the listings; a None or blank argument means no filter."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def given(value: Any) -> bool:
    return value is not None and value != ""


def where_given(df: DataFrame, value: Any, predicate: Callable[[Any], Column]) -> DataFrame:
    return df.filter(predicate(value)) if given(value) else df


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive and literal: `%` and `_` have no special meaning."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def is_blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def local_date(time: Column, zone: str | None = None) -> Column:
    """The date of a stored UTC time, seen in `zone`."""
    if zone is None:
        return F.to_date(time)
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), time.cast("timestamp_ntz")))


def _offsets(df: DataFrame, zone: str, day: date) -> tuple[int, int]:
    """The smallest and the largest offset from UTC, in seconds, that a zone has in the days around `day`."""
    time = df.sparkSession._jvm.java.time
    rules = time.ZoneId.of(zone).getRules()
    midnight = int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp())
    at, last = time.Instant.ofEpochSecond(midnight - 2 * 86_400), midnight + 2 * 86_400
    found = [rules.getOffset(at).getTotalSeconds()]
    while (change := rules.nextTransition(at)) is not None and change.getInstant().getEpochSecond() <= last:
        at = change.getInstant()
        found.append(change.getOffsetAfter().getTotalSeconds())
    return min(found), max(found)


def dates_between(
    df: DataFrame, time: Column, first: str | None, last: str | None, zone: str | None = None
) -> DataFrame:
    """Both ends included.

    The bounds compare with the time itself, so they reach the parquet scan; a
    date function on the column would not. Without a zone they are the whole
    predicate. With one, they are the first and last instants that can have such
    a date by the offsets around it. Where clocks go back over midnight a date
    comes twice, so the local date is compared as well, on what the scan leaves.
    """
    days = {name: date.fromisoformat(str(value)[:10]) if given(value) else None for name, value in (("first", first), ("last", last))}
    bound = lambda day, seconds: F.lit(datetime(day.year, day.month, day.day) + timedelta(seconds=seconds)).cast("timestamp_ntz")
    if days["first"]:
        ahead = _offsets(df, zone, days["first"])[1] if zone else 0
        df = df.filter(time >= bound(days["first"], -ahead))
    if days["last"]:
        end = days["last"] + timedelta(days=1)
        behind = _offsets(df, zone, end)[0] if zone else 0
        df = df.filter(time < bound(end, -behind))
    if zone is None:
        return df
    local = local_date(time, zone)
    df = where_given(df, days["first"], lambda d: local >= F.lit(d))
    return where_given(df, days["last"], lambda d: local <= F.lit(d))


def scores_between(
    df: DataFrame, lowest: float | str | None, highest: float | str | None
) -> DataFrame:
    """Both ends included, as given: scores have two places, so a finer lower bound is
    raised to the next one and a finer upper bound lowered, which keeps the same rows
    and lets the bound reach the scan. Bounds beyond any score keep all scores or none."""
    score, most = F.col("score"), Decimal("999.99")

    def at_least(value):
        bound = Decimal(str(value)).quantize(Decimal("0.01"), ROUND_CEILING)
        return F.lit(False) if bound > most else score >= F.lit(max(bound, -most))

    def at_most(value):
        bound = Decimal(str(value)).quantize(Decimal("0.01"), ROUND_FLOOR)
        return F.lit(False) if bound < -most else score <= F.lit(min(bound, most))

    return where_given(where_given(df, lowest, at_least), highest, at_most)


def feedback_is(df: DataFrame, answer: str | None) -> DataFrame:
    """`yes` keeps rows with a text, `no` rows whose feedback is null or empty."""
    if answer == "yes":
        return df.filter(~is_blank(F.col("feedback")))
    if answer == "no":
        return df.filter(is_blank(F.col("feedback")))
    return df
