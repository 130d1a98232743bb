"""The eight saved questions and the three summary views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from classmeter.functions.exprs import exact_average, half_up, topic_line
from classmeter.sources.tables import Tables


def names(t: Tables, key: str, name: str, *more: str) -> DataFrame:
    """User names keyed for a join."""
    return t.user.select(F.col("user_id").alias(key), F.col("name").alias(name), *more)


def students_without_attempts(t: Tables) -> DataFrame:
    # The large side is cut to its distinct ids before the shuffle.
    active = t.attempt.select(F.col("student_id").alias("user_id")).distinct()
    idle = t.student.select("user_id").join(active, "user_id", "left_anti")
    found = idle.join(t.user, "user_id")
    return found.select(F.col("user_id").alias("student_id"), "name", "email").orderBy(
        "name", "student_id"
    )


def problems_by_mentor(t: Tables, mentor_name: str) -> DataFrame:
    author = names(t, "user_id", "mentor_name").filter(F.col("mentor_name") == mentor_name)
    found = t.problem.join(author, "user_id")
    return found.select("problem_id", "title", "difficulty", "mentor_name").orderBy("problem_id")


def problem_count_by_difficulty(t: Tables) -> DataFrame:
    counts = t.problem.groupBy("difficulty").agg(F.count(F.lit(1)).alias("problem_count"))
    counts = counts.filter("problem_count > 0")
    return counts.orderBy(F.desc("problem_count"), "difficulty")


def top_students(t: Tables, n: int = 5, min_attempts: int = 1) -> DataFrame:
    """Best students by average; the order uses the rounded average."""
    per_student = t.attempt.groupBy("student_id").agg(
        F.sum("score").alias("total"),
        F.count("score").alias("scored"),
        F.count(F.lit(1)).alias("total_attempts"),
    )
    per_student = per_student.filter(F.col("total_attempts") >= min_attempts)
    enrolled = t.student.select(F.col("user_id").alias("student_id"))
    ranked = (
        per_student.join(enrolled, "student_id")
        .join(names(t, "student_id", "student_name"), "student_id")
        .select(
            "student_id",
            "student_name",
            half_up(exact_average(F.col("total"), F.col("scored")), 2).alias("avg_score"),
            "total_attempts",
        )
    )
    order = [
        F.desc_nulls_last("avg_score"), F.desc("total_attempts"), F.asc("student_name"),
        F.asc("student_id"),
    ]
    return ranked.orderBy(*order).limit(n)


def best_score_per_problem(t: Tables) -> DataFrame:
    """All attempts that reach their problem's best score.

    The maximum is aggregated before its shuffle and joined back on problem
    and score, so a problem with a third of the attempts is spread by score
    and by adaptive skew splitting; a rank would sort it in one task.
    """
    best = t.attempt.groupBy("problem_id").agg(F.max("score").alias("score"))
    hits = t.attempt.select("problem_id", "student_id", "score").join(best, ["problem_id", "score"])
    titles = t.problem.select("problem_id", F.col("title").alias("problem_title"))
    found = hits.join(titles, "problem_id").join(names(t, "student_id", "student_name"), "student_id")
    return found.select(
        "problem_id", "problem_title", "student_id", "student_name", "score"
    ).orderBy("problem_id", F.desc("score"), "student_id")


def first_attempt_failures(t: Tables, pass_mark: int = 60, ratio: float = 0.5) -> DataFrame:
    """Problems failed at the first attempt by more than `ratio` of all students."""
    failed = F.count_if(F.col("score") < pass_mark).alias("failed_first_attempts")
    first = t.attempt.filter("attempt_no = 1").groupBy("problem_id").agg(failed)
    everyone = t.student.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = first.filter("failed_first_attempts > 0").withColumn("total_students", everyone)
    counted = counted.filter(F.col("failed_first_attempts") > F.col("total_students") * F.lit(ratio))
    titles = t.problem.select("problem_id", F.col("title").alias("problem_title"))
    return (
        counted.join(titles, "problem_id")
        .select(
            "problem_id",
            "problem_title",
            "failed_first_attempts",
            "total_students",
            (F.col("failed_first_attempts") / F.col("total_students")).alias("fail_ratio"),
        )
        .orderBy(F.desc("fail_ratio"), "problem_id")
    )


def scenario_score_by_difficulty(t: Tables) -> DataFrame:
    # Attempts shrink to one row per problem before the join.
    per_problem = t.attempt.groupBy("problem_id").agg(
        F.sum("score").alias("total"),
        F.count("score").alias("scored"),
        F.count(F.lit(1)).alias("n"),
    )
    generated = t.problem.filter("scenario_no is not null").select("problem_id", "difficulty")
    levels = (
        per_problem.join(generated, "problem_id")
        .groupBy("difficulty")
        .agg(
            F.sum("total").alias("total"),
            F.sum("scored").alias("scored"),
            F.sum("n").alias("attempt_count"),
        )
    )
    mean = half_up(exact_average(F.col("total").cast("decimal(28,2)"), F.col("scored")), 2)
    levels = levels.filter("attempt_count > 0")
    return levels.select("difficulty", mean.alias("avg_score"), "attempt_count").orderBy(
        F.desc_nulls_last("avg_score"), "difficulty"
    )


def notification_counts(t: Tables) -> DataFrame:
    received = t.receive.groupBy(F.col("receiver_id").alias("user_id")).agg(
        F.count("noti_id").alias("n")
    )
    counted = t.user.join(received, "user_id", "left")
    return counted.select(
        "user_id", "name", "email", F.coalesce("n", F.lit(0)).alias("notif_count")
    ).orderBy(F.desc("notif_count"), "name", "user_id")


def attempt_totals(t: Tables, by: str, distinct: str) -> DataFrame:
    """Attempt figures per `by`, with the distinct count of another key.

    Two steps, so the first shuffle is spread over (by, distinct) and the
    second moves one partial row per task and key.
    """
    pairs = t.attempt.groupBy(by, distinct).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("scored"),
        F.sum("score").alias("total"),
        F.max("score").alias("highest"),
    )
    return pairs.groupBy(by).agg(
        F.count(distinct).alias("others"),
        F.sum("n").alias("n"),
        F.sum("scored").alias("scored"),
        F.sum("total").cast("decimal(28,2)").alias("total"),
        F.max("highest").alias("highest"),
    )


def mean_of_totals() -> Column:
    return F.try_divide(F.col("total").cast("double"), F.col("scored"))


def zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def student_performance(t: Tables, totals: DataFrame | None = None) -> DataFrame:
    """One row per student, also those without attempts. `totals` are those of `attempt_totals`, if they are at hand."""
    return _student_figures(t, totals).select(
        "user_id",
        "name",
        "email",
        zero("others").alias("problems_attempted"),
        mean_of_totals().alias("average_score"),
        F.col("highest").alias("highest_score"),
        zero("n").alias("total_attempts"),
    )


def _student_figures(t: Tables, totals: DataFrame | None = None) -> DataFrame:
    totals = attempt_totals(t, "student_id", "problem_id") if totals is None else totals
    totals = totals.withColumnRenamed("student_id", "user_id")
    people = t.student.select("user_id").join(t.user.select("user_id", "name", "email"), "user_id")
    return people.join(totals, "user_id", "left")


def topic_sets(bridge: DataFrame, key: str) -> DataFrame:
    """Topics of each entity as a sorted line, and their number."""
    # The bridge holds each pair once, so a set is no larger than the vocabulary.
    grouped = bridge.groupBy(key).agg(F.collect_set("topic_name").alias("set"))
    return grouped.select(key, topic_line(F.col("set")).alias("topics"), F.size("set").alias("n_topics"))


def problem_statistics(t: Tables, faithful: bool = True, totals: DataFrame | None = None) -> DataFrame:
    """One row per problem. The faithful form counts an attempt once per topic."""
    totals = attempt_totals(t, "problem_id", "student_id") if totals is None else totals
    factor = F.greatest(zero("n_topics"), F.lit(1)) if faithful else F.lit(1)
    return (
        t.problem.select("problem_id", "title", "difficulty", "user_id")
        .join(totals, "problem_id", "left")
        .join(topic_sets(t.have_topic, "problem_id"), "problem_id", "left")
        .join(names(t, "user_id", "created_by_mentor"), "user_id", "left")
        .select(
            "problem_id",
            "title",
            "difficulty",
            "topics",
            zero("others").alias("students_attempted"),
            mean_of_totals().alias("average_score"),
            (zero("n") * factor).alias("total_attempts"),
            "created_by_mentor",
        )
    )


def created_totals(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(problems, resources) per author."""
    authored = t.problem.groupBy("user_id").agg(F.count("problem_id").alias("problems"))
    return authored, t.resource.groupBy("user_id").agg(F.count("resource_id").alias("resources"))


def graded_totals(t: Tables) -> DataFrame:
    return attempt_totals(t.replace(attempt=t.attempt.filter("mentor_id is not null")), "mentor_id", "student_id")


def mentor_activity(
    t: Tables, created: tuple[DataFrame, DataFrame] | None = None, graded: DataFrame | None = None
) -> DataFrame:
    """One row per mentor; three separate totals instead of the product of three joins."""
    authored, uploaded = created_totals(t) if created is None else created
    graded = (graded_totals(t) if graded is None else graded).withColumnRenamed("mentor_id", "user_id")
    return (
        t.mentor.select("user_id")
        .join(names(t, "user_id", "mentor_name"), "user_id")
        .join(authored, "user_id", "left")
        .join(uploaded, "user_id", "left")
        .join(graded, "user_id", "left")
        .select(
            "user_id",
            "mentor_name",
            zero("problems").alias("problems_created"),
            zero("resources").alias("resources_uploaded"),
            zero("others").alias("students_mentored"),
            mean_of_totals().alias("avg_student_score"),
        )
    )
