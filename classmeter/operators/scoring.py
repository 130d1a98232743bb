"""Scoring of submitted SQL texts against the problems' right answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from classmeter.functions import sqltext
from classmeter.functions.exprs import round_float
from classmeter.session import written
from classmeter.sources.tables import Tables

PARTS = ("from", "select", "where")
SETS = {
    "from": ("tables", sqltext.extract_tables),
    "select": ("columns", sqltext.extract_columns),
    "where": ("conditions", sqltext.extract_conditions),
}


def take_apart(df: DataFrame, text: str, side: str) -> DataFrame:
    """Add the clauses and token sets of a text column as `<side>_raw` and `<side>`.

    Each step is a column of its own, so that no step is computed twice.
    """
    df = df.withColumn("_normal", sqltext.normalize_sql_text(F.col(text)))
    df = df.withColumn(f"{side}_raw", sqltext.clauses_of(F.col("_normal"))).drop("_normal")
    sets = [
        extract(F.col(f"{side}_raw")[part]).alias(name) for part, (name, extract) in SETS.items()
    ]
    return df.withColumn(side, F.struct(*sets))


def score_submissions(submissions: DataFrame, problem: DataFrame) -> DataFrame:
    """Each submission with its score and the details behind it.

    Right answers are taken apart once per problem, before the join; the
    submissions after it, so that the shuffle carries texts and not their parts.
    Hot problems are left to adaptive skew splitting, as the problem side has
    one row per key.
    """
    answers = take_apart(
        problem.select("problem_id", "correct_answer"), "correct_answer", "correct"
    ).drop("correct_answer")
    paired = take_apart(submissions.join(answers, "problem_id"), "student_sql", "student")

    same = {part: F.col(f"correct.{name}") == F.col(f"student.{name}") for part, (name, _) in SETS.items()}
    f1 = {part: F.col(f"_{part}_f1") for part in PARTS}
    both = {part: (F.col(f"correct.{name}"), F.col(f"student.{name}")) for part, (name, _) in SETS.items()}
    # Equal sets share all they hold.
    shared = {part: F.when(same[part], F.size(both[part][0])).otherwise(sqltext.hits(*both[part])) for part in PARTS}
    paired = paired.withColumns({f"_{part}_hits": shared[part] for part in PARTS})
    paired = paired.withColumns(
        {
            f"_{part}_f1": sqltext.f1_of(F.col(f"_{part}_hits"), *map(F.size, both[part]))
            for part in PARTS
        }
    )
    # Built as one method with the rounding, the details would be too long for the JVM to compile; Spark
    # splits what stands beside a lambda.
    equal = F.forall(F.array(*same.values()), lambda ok: ok)
    paired = paired.withColumns(
        {f"_{part}_points": F.lit(float(sqltext.WEIGHTS[part])) * f1[part] for part in PARTS}
    )
    points = {part: F.col(f"_{part}_points") for part in PARTS}
    paired = paired.withColumn("_total", points["from"] + points["select"] + points["where"])
    breakdown = [round_float(points[part], 1).alias(part) for part in PARTS]
    breakdown += [round_float(f1[part], 3).alias(f"{part}_f1") for part in PARTS]
    details = F.struct(
        "correct",
        "student",
        *(same[part].alias(f"{part}_ok") for part in PARTS),
        equal.alias("is_equal"),
        F.struct(*breakdown).alias("score_breakdown"),
        F.struct("correct_raw", "student_raw").alias("debug"),
    )
    score = F.when(equal, 100.0).otherwise(round_float(F.col("_total"), 1))
    return paired.select(*submissions.columns, score.alias("score"), details.alias("details"))


def answered(submissions: DataFrame) -> DataFrame:
    """Submissions with a text; blank ones are refused."""
    return submissions.filter(sqltext.strip(F.coalesce("student_sql", F.lit(""))) != "")


def submit(t: Tables, submissions: DataFrame) -> DataFrame:
    """Score a batch and number it as new attempts."""
    from classmeter.operators.writes import number_attempts

    return number_attempts(t, score_submissions(answered(submissions), t.problem))


def take_submissions(
    t: Tables, submissions: DataFrame, now: Column | None = None
) -> tuple[Tables, DataFrame]:
    """The whole insert of a batch: (next snapshot, refused submissions with a reason).

    Texts are scored; rows that break the feedback or the score rule are refused
    like blank texts and unknown problems, and use up no number. The others are
    numbered, and good scores raise a notice. New rows stand in attempt, notification and receive.
    """
    from classmeter.operators import quality, writes

    batch = written(submissions, "submissions")
    texts = sqltext.strip(F.coalesce("student_sql", F.lit(""))) != ""
    known = t.problem.select("problem_id")
    reason = lambda text: F.lit(text).alias("reason")
    refused = [
        batch.filter(~texts).select("student_id", "problem_id", reason("no answer")),
        batch.filter(texts).join(known, "problem_id", "left_anti").select(
            "student_id", "problem_id", reason("unknown problem")
        ),
    ]
    scored = score_submissions(answered(batch), t.problem).select(*batch.columns, "score")
    unread = {"mentor_id": F.lit(None).cast("long"), "feedback": F.lit(None).cast("string")}
    good = written(scored.withColumns(unread), "scored")
    for rule in (quality.feedback_rule, quality.score_range_rule):
        good, broken = rule(good)
        refused.append(broken.select("student_id", "problem_id", "reason"))
    new = written(writes.number_attempts(t, good, settled=True), "new-attempts")
    sent, got = writes.high_score_alerts(t, new, now=now)
    after = t.replace(
        attempt=t.attempt.unionByName(new),
        notification=t.notification.unionByName(sent),
        receive=t.receive.unionByName(got),
    )
    return after, reduce(DataFrame.union, refused)
