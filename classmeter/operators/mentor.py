"""Listings and figures of the mentor side. A None id means all mentors or entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from classmeter.functions import filters
from classmeter.functions.exprs import average, exact_average, half_even, round_float
from classmeter.functions.joins import left_join_sparse
from classmeter.operators import reports
from classmeter.operators.learner import first_per_key, in_order, newest, of, with_topic
from classmeter.operators.reports import names, topic_sets, zero
from classmeter.sources.tables import Tables


def mentor_summary(t: Tables, mentor_id: int | None = None) -> DataFrame:
    """The mentor's dashboard row; missing figures are 0, and so is a missing average."""
    activity = of(reports.mentor_activity(t), "user_id", mentor_id)
    return activity.withColumn("avg_student_score", F.coalesce("avg_student_score", F.lit(0.0)))


def _owned(t: Tables, mentor_id: int | None) -> DataFrame:
    """Problems by author, keyed `author_id`."""
    problem = t.problem.withColumnRenamed("user_id", "author_id")
    return of(problem, "author_id", mentor_id)


def _attempts_on_owned(t: Tables, mentor_id: int | None, attempts: DataFrame) -> DataFrame:
    return attempts.join(_owned(t, mentor_id).select("problem_id", "author_id", "title"), "problem_id")


def pending_reviews(
    t: Tables, mentor_id: int | None = None, n: int = 10, blank_is_pending: bool = False
) -> DataFrame:
    """Oldest attempts on the mentor's problems that still lack feedback."""
    feedback = F.col("feedback")
    pending = filters.is_blank(feedback) if blank_is_pending else feedback.isNull()
    waiting = _attempts_on_owned(t, mentor_id, t.attempt.filter(pending))
    order = [
        F.asc_nulls_last("submit_time"), F.asc("student_id"), F.asc("problem_id"),
        F.asc("attempt_no"), F.asc("score"),
    ]
    first = first_per_key(waiting, "author_id", order, n, "place")
    named = first.join(names(t, "student_id", "student_name"), "student_id").select(
        F.col("author_id").alias("mentor_id"), "place", "student_id", "student_name",
        "problem_id", "title", "attempt_no", "score", "submit_time",
    )
    return in_order(named, mentor_id, "place")


def recent_problems(t: Tables, mentor_id: int | None = None, n: int = 5) -> DataFrame:
    order = [F.desc_nulls_first("create_time"), F.desc("problem_id")]
    latest = first_per_key(_owned(t, mentor_id), "author_id", order, n, "place")
    listed = latest.select(
        F.col("author_id").alias("mentor_id"), "place", "problem_id", "title", "difficulty",
        "create_time",
    )
    return in_order(listed, mentor_id, "place")


def feedback_given(t: Tables, mentor_id: int | None = None) -> DataFrame:
    """Attempts on each author's problems that carry a feedback text."""
    noted = t.attempt.filter(~filters.is_blank(F.col("feedback")))
    owned = _owned(t, mentor_id).select("problem_id", "author_id")
    if mentor_id is not None:
        noted = noted.join(owned, "problem_id", "left_semi")
    per_problem = noted.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_problem.join(owned, "problem_id")
        .groupBy(F.col("author_id").alias("mentor_id"))
        .agg(F.sum("n").alias("feedback_given"))
    )


def my_problems(
    t: Tables,
    mentor_id: int | None = None,
    difficulty: str | None = None,
    topic: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    min_attempts: int | None = None,
    max_attempts: int | None = None,
    zone: str | None = None,
    pass_mark: int = 60,
) -> DataFrame:
    """Each problem of the author with attempt figures and topics, in one pass each."""
    owned = _owned(t, mentor_id)
    owned = filters.where_given(owned, difficulty, lambda d: F.col("difficulty") == d)
    owned = with_topic(t, owned, topic)
    owned = filters.dates_between(owned, F.col("create_time"), date_from, date_to, zone)
    attempts = t.attempt
    if any(filters.given(v) for v in (mentor_id, difficulty, topic, date_from, date_to)):
        # A few problems: their attempts only are aggregated.
        attempts = attempts.join(owned.select("problem_id"), "problem_id", "left_semi")
    pairs = attempts.groupBy("problem_id", "student_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("scored"),
        F.sum("score").alias("total"),
        F.count_if(F.col("score") >= pass_mark).alias("passed"),
    )
    figures = pairs.groupBy("problem_id").agg(
        F.sum("n").alias("n"),
        F.sum("scored").alias("scored"),
        F.sum("total").cast("decimal(28,2)").alias("total"),
        F.sum("passed").alias("passed"),
        F.count("student_id").alias("students"),
    )
    mean = half_even(exact_average(F.col("total"), F.col("scored")), 2)
    rate = round_float(F.try_divide(F.col("passed").cast("double"), F.col("n")) * 100, 2)
    found = (
        owned.join(figures, "problem_id", "left")
        .join(topic_sets(t.have_topic, "problem_id"), "problem_id", "left")
        .select(
            F.col("author_id").alias("mentor_id"),
            "problem_id",
            "title",
            "difficulty",
            "create_time",
            zero("n").alias("total_attempts"),
            F.coalesce(mean, F.lit(0.0)).alias("avg_score"),
            F.coalesce(rate, F.lit(0.0)).alias("pass_rate"),
            zero("students").alias("unique_students"),
            F.coalesce("topics", F.lit("")).alias("topics"),
        )
    )
    found = filters.where_given(found, min_attempts, lambda m: F.col("total_attempts") >= int(m))
    return filters.where_given(found, max_attempts, lambda m: F.col("total_attempts") <= int(m))


def problem_analytics(t: Tables, problem_id: int | None = None) -> DataFrame:
    """Attempts, average and score bands of each problem; a missing score is in no band."""
    score = F.col("score")
    figures = of(t.attempt, "problem_id", problem_id).groupBy("problem_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("score").alias("total"),
        F.count("score").alias("scored"),
        F.count_if(score >= 90).alias("high"),
        F.count_if((score >= 60) & (score < 90)).alias("medium"),
        F.count_if(score < 60).alias("low"),
    )
    mean = half_even(exact_average(F.col("total"), F.col("scored")), 2)
    problems = of(t.problem.select("problem_id", "title"), "problem_id", problem_id)
    return problems.join(figures, "problem_id", "left").select(
        "problem_id",
        "title",
        zero("n").alias("total_attempts"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_score"),
        zero("high").alias("high_scores"),
        zero("medium").alias("medium_scores"),
        zero("low").alias("low_scores"),
    )


def recent_attempts_of_problem(
    t: Tables, problem_id: int | None = None, n: int = 10
) -> DataFrame:
    order = [
        F.desc_nulls_first("submit_time"), F.asc("student_id"), F.desc("attempt_no"),
        F.desc_nulls_first("score"),
    ]
    tried = of(t.attempt, "problem_id", problem_id)
    latest = first_per_key(tried, "problem_id", order, n, "place")
    named = latest.join(names(t, "student_id", "student_name"), "student_id").select(
        "problem_id", "place", "student_id", "student_name", "attempt_no", "score", "submit_time"
    )
    return in_order(named, problem_id, "place")


def review_attempts(
    t: Tables,
    mentor_id: int | None = None,
    has_feedback: str | None = None,
    score_min: float | None = None,
    score_max: float | None = None,
    problem_id: int | None = None,
    student_id: int | None = None,
) -> DataFrame:
    """Attempts on the author's problems, newest first, with all names.

    What is wider joins later: reviewers, whom few attempts have, then students,
    then titles, so that no shuffle carries a title.
    """
    found = filters.feedback_is(t.attempt, has_feedback)
    found = filters.scores_between(found, score_min, score_max)
    found = of(of(found, "problem_id", problem_id), "student_id", student_id)
    if mentor_id is not None:
        found = found.join(_owned(t, mentor_id).select("problem_id"), "problem_id", "left_semi")
    reviewers = names(t, "mentor_id", "reviewer_name")
    found = left_join_sparse(found, reviewers, "mentor_id", ["student_id", "problem_id"]).drop("mentor_id")
    found = found.join(names(t, "student_id", "student_name"), "student_id")
    found = _attempts_on_owned(t, mentor_id, found)
    return in_order(
        found.select(
            "author_id", "problem_id", "title", "student_id", "student_name", "attempt_no",
            "score", "submit_time", "reviewer_name", "feedback",
        ),
        mentor_id,
        *newest(),
        "student_id",
    )


def my_resources(t: Tables, mentor_id: int | None = None) -> DataFrame:
    """Resources, newest first, with accesses and topics."""
    mine = of(t.resource, "user_id", mentor_id)
    log = t.access
    if mentor_id is not None:
        log = log.join(mine.select("resource_id"), "resource_id", "left_semi")
    listed = (
        mine.join(_totals(log), "resource_id", "left")
        .join(topic_sets(t.resourcetopic, "resource_id"), "resource_id", "left")
        .select(
            F.col("user_id").alias("mentor_id"),
            "resource_id",
            "title",
            "res_type",
            "uploaded_time",
            zero("total_accesses").alias("access_count"),
            zero("unique_students").alias("unique_students"),
            F.coalesce("topics", F.lit("")).alias("topics"),
        )
    )
    return in_order(listed, mentor_id, F.desc_nulls_first("uploaded_time"), F.desc("resource_id"))


def resource_analytics(t: Tables, resource_id: int | None = None) -> DataFrame:
    """The access log with student names, newest first."""
    log = of(t.access, "resource_id", resource_id)
    enrolled = t.student.select(F.col("user_id").alias("student_id"))
    named = (
        log.join(enrolled, "student_id")
        .join(names(t, "student_id", "student_name"), "student_id")
        .select("resource_id", "access_time", "student_id", "student_name")
    )
    return in_order(named, resource_id, F.desc_nulls_first("access_time"), "student_id")


def resource_totals(t: Tables, resource_id: int | None = None) -> DataFrame:
    """Accesses and distinct students of each resource in the log."""
    return _totals(of(t.access, "resource_id", resource_id))


def _totals(log: DataFrame) -> DataFrame:
    pairs = log.groupBy("resource_id", "student_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("resource_id").agg(
        F.sum("n").alias("total_accesses"), F.count("student_id").alias("unique_students")
    )


def hardest_problems(t: Tables, n: int = 5) -> DataFrame:
    """Problems with the lowest average score."""
    means = t.attempt.groupBy("problem_id").agg(
        average("score").alias("avg_score"), F.count(F.lit(1)).alias("attempts")
    )
    # References hold, so every scored problem has a title; only `n` of them are looked up.
    lowest = means.filter("avg_score is not null").orderBy("avg_score", "problem_id").limit(n)
    named = lowest.join(t.problem.select("problem_id", "title"), "problem_id")
    return named.select("problem_id", "title", "avg_score", "attempts").orderBy("avg_score", "problem_id")


def repeat_failers(t: Tables, more_than: int = 3, pass_mark: int = 60) -> DataFrame:
    """Students with more than `more_than` failed attempts."""
    failed = t.attempt.filter(F.col("score") < pass_mark)
    counts = failed.groupBy("student_id").agg(F.count(F.lit(1)).alias("failures"))
    many = counts.filter(F.col("failures") > more_than)
    named = many.join(names(t, "student_id", "student_name"), "student_id")
    return named.select("student_id", "student_name", "failures").orderBy(
        F.desc("failures"), "student_id"
    )


def topic_average(t: Tables, topic: str) -> DataFrame:
    """Average score over the problems of a topic; an attempt counts once."""
    match = t.have_topic.filter(filters.contains_text(F.col("topic_name"), topic))
    chosen = match.select("problem_id").distinct()
    per_problem = t.attempt.groupBy("problem_id").agg(
        F.sum("score").alias("total"), F.count("score").alias("scored")
    )
    kept = per_problem.join(chosen, "problem_id", "left_semi")
    return kept.agg(
        F.try_divide(F.sum("total").cast("double"), F.sum("scored")).alias("avg_score"),
        F.coalesce(F.sum("scored"), F.lit(0)).alias("scored_attempts"),
    )
