"""Listings and figures of the learner side. A None id means all students."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from classmeter.functions import filters
from classmeter.functions.exprs import average, exact_average, half_even
from classmeter.functions.numbering import number_within
from classmeter.operators import reports
from classmeter.operators.reports import names, zero
from classmeter.session import written
from classmeter.sources.tables import Tables

def newest() -> list[Column]:
    """Full order of one student's attempts, newest first."""
    return [
        F.desc_nulls_first("submit_time"),
        F.desc("attempt_no"),
        F.asc("problem_id"),
        F.desc_nulls_first("score"),
    ]


def of(df: DataFrame, column: str, value: int | None) -> DataFrame:
    return filters.where_given(df, value, lambda v: F.col(column) == v)


def in_order(df: DataFrame, one: int | None, *order: Column | str) -> DataFrame:
    """The listing of one entity in its order.

    For all entities at once the rows carry their place or time, and a sort of
    the whole result would only be one more shuffle.
    """
    return df if one is None else df.orderBy(*order)


def first_per_key(df: DataFrame, key: str, order: list, n: int, place: str) -> DataFrame:
    """The first `n` rows of each key.

    The limit on the row number is applied in the map tasks too, so a key
    sends at most `n` rows per task however large it is.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(place, rank).filter(F.col(place) <= n)


def student_summary(t: Tables, student_id: int | None = None) -> DataFrame:
    """The student's summary row, with the average as displayed."""
    shown = half_even(exact_average(F.col("total"), F.col("scored")), 1)
    return of(reports._student_figures(t), "user_id", student_id).select(
        F.col("user_id").alias("student_id"),
        "name",
        "email",
        zero("others").alias("problems_attempted"),
        F.coalesce(shown, F.lit(0.0)).alias("avg_score"),
        F.col("highest").alias("highest_score"),
        zero("n").alias("total_attempts"),
    )


def recent_attempts(t: Tables, student_id: int | None = None, n: int = 10) -> DataFrame:
    mine = of(t.attempt, "student_id", student_id)
    recent = first_per_key(mine, "student_id", newest(), n, "place")
    problem = t.problem.select("problem_id", "title", "difficulty")
    listed = recent.join(problem, "problem_id").select(
        "student_id", "place", "problem_id", "title", "difficulty", "attempt_no", "score",
        "submit_time",
    )
    return in_order(listed, student_id, "place")


def recommend_problems(t: Tables, student_id: int | None = None, n: int = 5) -> DataFrame:
    """The first `n` Easy or Medium problems each student has not tried.

    Candidates get their place in the list once. For one student, the place of
    the j-th untried one is j plus the number of tried ones before it: the i-th
    tried one, at place p, has p - i untried ones ahead. So a count per student
    gives the wanted places, and no student is paired with all problems.
    """
    open_problems = t.problem.filter(F.col("difficulty").isin("Easy", "Medium")).select(
        "problem_id", "title", "difficulty"
    )
    order = [F.asc("difficulty"), F.asc("problem_id")]
    listed = number_within(open_problems, [], order, "place")
    # Repeats go before the joins, so that a hot pair is one row. A student who
    # tried k problems meets the n-th untried one by place n + k; later tried
    # ones do not matter, which leaves few rows to number.
    mine = of(t.attempt, "student_id", student_id).select("student_id", "problem_id").distinct()
    mine = written(mine, "tried-pairs")
    reach = mine.groupBy("student_id").agg((F.count(F.lit(1)) + n).alias("reach"))
    tried = mine.join(listed.select("problem_id", "place"), "problem_id")
    tried = tried.join(reach, "student_id").filter("place <= reach")
    tried = tried.select("student_id", "place")
    tried = number_within(tried, ["student_id"], [F.asc("place")], "i")
    ahead = [
        F.count_if(F.col("place") - F.col("i") < j).alias(f"before{j}") for j in range(1, n + 1)
    ]
    skipped = tried.groupBy("student_id").agg(*ahead)
    students = of(t.student.select(F.col("user_id").alias("student_id")), "student_id", student_id)
    slots = F.array(
        *(
            F.struct(F.lit(j).alias("choice"), (zero(f"before{j}") + j).alias("place"))
            for j in range(1, n + 1)
        )
    )
    wanted = students.join(skipped, "student_id", "left").select(
        "student_id", F.inline(slots)
    )
    found = wanted.join(listed, "place")
    found = found.select("student_id", "choice", "problem_id", "title", "difficulty")
    return in_order(found, student_id, "choice")


def problems_passed(t: Tables, student_id: int | None = None) -> DataFrame:
    full = of(t.attempt.filter("score = 100"), "student_id", student_id)
    passed = full.select("student_id", "problem_id").distinct()
    return passed.groupBy("student_id").agg(F.count(F.lit(1)).alias("problems_passed"))


def with_topic(t: Tables, problems: DataFrame, topic: str | None) -> DataFrame:
    """Problems having a topic whose name contains the text."""
    if not filters.given(topic):
        return problems
    match = t.have_topic.filter(filters.contains_text(F.col("topic_name"), topic))
    return problems.join(match.select("problem_id").distinct(), "problem_id", "left_semi")


def browse_problems(
    t: Tables,
    student_id: int | None = None,
    difficulty: str | None = None,
    topic: str | None = None,
    attempted: str | None = None,
    generated: str | None = None,
) -> DataFrame:
    found = filters.where_given(t.problem, difficulty, lambda d: F.col("difficulty") == d)
    if generated == "scenario":
        found = found.filter("scenario_no is not null")
    elif generated == "normal":
        found = found.filter("scenario_no is null")
    found = with_topic(t, found, topic)
    if attempted in ("yes", "no"):
        mine = of(t.attempt, "student_id", student_id).select("problem_id").distinct()
        kind = "left_semi" if attempted == "yes" else "left_anti"
        found = found.join(mine, "problem_id", kind)
    return (
        found.join(names(t, "user_id", "author"), "user_id", "left")
        .join(reports.topic_sets(t.have_topic, "problem_id"), "problem_id", "left")
        .select("problem_id", "title", "difficulty", "author", "scenario_no", "topics")
        .orderBy("difficulty", "problem_id")
    )


def topic_list(t: Tables) -> DataFrame:
    return t.topic.select("topic_name", "description").orderBy("topic_name")


def problem_attempts(
    t: Tables, student_id: int | None = None, problem_id: int | None = None
) -> DataFrame:
    mine = of(of(t.attempt, "student_id", student_id), "problem_id", problem_id)
    listed = mine.select(
        "student_id", "problem_id", "attempt_no", "score", "submit_time", "feedback"
    )
    return in_order(listed, student_id, *newest())


def latest_score(t: Tables, student_id: int | None = None) -> DataFrame:
    """Attempts and newest score per student and problem."""
    # A maximum of a struct would be aggregated by sorting. The newest time and
    # the attempts at each time are numbers, which hash aggregates hold.
    pair = ["student_id", "problem_id"]
    late = F.coalesce(F.unix_micros(F.col("submit_time").cast("timestamp")), F.lit(-(2**63) + 1))
    mine = of(t.attempt, "student_id", student_id).select(*pair, "attempt_no", "score", late.alias("at"))
    best = mine.groupBy(*pair, "at", "attempt_no").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("score")
    )
    newest = best.groupBy(*pair).agg(F.sum("n").alias("attempts"), F.max("at").alias("at"))
    last = best.join(newest.drop("attempts"), [*pair, "at"], "left_semi")
    last = last.groupBy(*pair).agg(F.max_by("score", "attempt_no").alias("latest_score"))
    return newest.join(last, pair).select(*pair, "attempts", "latest_score")


def _my_attempts(
    t, student_id, date_from, date_to, score_min, score_max, difficulty, has_feedback, zone
) -> DataFrame:
    mine = of(t.attempt, "student_id", student_id)
    mine = filters.dates_between(mine, F.col("submit_time"), date_from, date_to, zone)
    mine = filters.scores_between(mine, score_min, score_max)
    mine = filters.feedback_is(mine, has_feedback)
    problem = t.problem.select("problem_id", "title", "difficulty")
    problem = filters.where_given(problem, difficulty, lambda d: F.col("difficulty") == d)
    return mine.join(problem, "problem_id")


def my_attempts(
    t: Tables,
    student_id: int | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    score_min: float | None = None,
    score_max: float | None = None,
    difficulty: str | None = None,
    has_feedback: str | None = None,
    zone: str | None = None,
) -> DataFrame:
    found = _my_attempts(
        t, student_id, date_from, date_to, score_min, score_max, difficulty, has_feedback, zone
    )
    listed = found.select(
        "student_id", "problem_id", "title", "difficulty", "attempt_no", "score", "submit_time",
        "feedback",
    )
    return in_order(listed, student_id, *newest())


def my_attempt_stats(
    t: Tables,
    student_id: int | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    score_min: float | None = None,
    score_max: float | None = None,
    difficulty: str | None = None,
    has_feedback: str | None = None,
    zone: str | None = None,
    high: int = 90,
) -> DataFrame:
    """Figures over `my_attempts`: one row for one student, else a row per student found."""
    found = _my_attempts(
        t, student_id, date_from, date_to, score_min, score_max, difficulty, has_feedback, zone
    )
    figures = [
        average("score").alias("avg_score"),
        F.count_if(F.col("score") >= high).alias("high_score_count"),
        F.count(F.lit(1)).alias("total_attempts"),
    ]
    if student_id is None:
        stats = found.groupBy("student_id").agg(*figures)
    else:
        stats = found.agg(*figures).withColumn("student_id", F.lit(student_id).cast("long"))
    percent = F.try_divide(F.col("high_score_count") * 100.0, F.col("total_attempts"))
    return stats.select(
        "student_id", "avg_score", "high_score_count", "total_attempts",
        percent.alias("high_score_pct"),
    )


# Sort choices of the attempts page.
SORTS = {
    "date_desc": ("submit_time", Column.desc_nulls_first),
    "date_asc": ("submit_time", Column.asc_nulls_last),
    "score_desc": ("score", Column.desc_nulls_last),
    "score_asc": ("score", Column.asc_nulls_last),
}


def attempt_outcomes(
    t: Tables,
    student_id: int | None = None,
    status: str | None = None,
    sort: str = "date_desc",
    pass_mark: int = 60,
) -> DataFrame:
    """Attempts marked Passed or Failed; a missing score is neither."""
    outcome = F.when(F.col("score") >= pass_mark, "Passed").when(F.col("score") < pass_mark, "Failed")
    marked = of(t.attempt, "student_id", student_id).withColumn("status", outcome)
    marked = filters.where_given(marked, status, lambda s: F.col("status") == s)
    column, direction = SORTS[sort]
    return marked.select(
        "student_id", "problem_id", "attempt_no", "score", "submit_time", "status"
    ).orderBy(direction(F.col(column)), "student_id", "problem_id", F.desc("attempt_no"))


def outcome_counts(t: Tables, student_id: int | None = None, pass_mark: int = 60) -> DataFrame:
    """Totals of the attempts page per student."""
    mine = of(t.attempt, "student_id", student_id)
    return mine.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(F.col("score") >= pass_mark).alias("passed_count"),
        F.count_if(F.col("score") < pass_mark).alias("failed_count"),
        average("score").alias("avg_score"),
    )


def scenario_list(t: Tables, student_id: int | None = None) -> DataFrame:
    """A student's scenarios numbered newest first."""
    mine = of(t.scenario, "student_id", student_id)
    order = [F.desc_nulls_first("created_at"), F.desc("scenario_no")]
    narrow = mine.select("student_id", "scenario_no", "created_at")
    listed = number_within(narrow, ["student_id"], order, "display_index")
    texts = mine.select("scenario_no", "scenario_description")
    listed = listed.join(texts, "scenario_no").select(
        "student_id", "display_index", "scenario_no", "created_at", "scenario_description"
    )
    return in_order(listed, student_id, "display_index")


def scenario_rank(t: Tables, scenario_no: int | None = None) -> DataFrame:
    """A scenario's number in oldest-first order, with its problems."""
    scenarios = t.scenario.select("student_id", "scenario_no", "created_at")
    if scenario_no is not None:
        owner = scenarios.filter(F.col("scenario_no") == scenario_no).select("student_id")
        scenarios = scenarios.join(owner, "student_id", "left_semi")
    order = [F.asc_nulls_last("created_at"), F.asc("scenario_no")]
    ranked = number_within(scenarios, ["student_id"], order, "display_index")
    ranked = of(ranked, "scenario_no", scenario_no)
    problems = t.problem.select("scenario_no", "problem_id", "title", "difficulty")
    listed = ranked.join(problems, "scenario_no", "left").select(
        "scenario_no", "student_id", "display_index", "problem_id", "title", "difficulty"
    )
    return in_order(listed, scenario_no, "problem_id")
