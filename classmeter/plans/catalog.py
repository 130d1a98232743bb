"""Every operator as a query over the test tables.

Queries cover whole relations: where an operator takes an id, the form for all
ids is used. Filters and limits are there only where they are the feature.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from classmeter.functions import exprs, sqltext
from classmeter.operators import admin, kept, learner, mentor, quality, questions, reports, scoring, writes
from classmeter.session import deal, shared_folder, written
from classmeter.sources import binding, tables
from classmeter.sources.binding import ADMINS, MENTORS
from classmeter.sources.schemas import SCHEMAS
from classmeter.sources.tables import Tables
from classmeter.streaming import streams

NOW = "timestamp_ntz'2024-06-01 12:00:00'"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def on_tables(key: str):
    """Register a query that needs the relations only."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(binding.bind(spark, sf_dir))
        return build

    return add


def on_session(key: str):
    """Register a query that also needs the session, for folders or raw tables."""

    def add(build: Query):
        QUERIES[key] = build
        return build

    return add


# --- sources, sinks, catalog


def row_counts(t: Tables) -> DataFrame:
    counts = [
        t[name].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("relation"), "n_rows")
        for name in SCHEMAS
    ]
    return reduce(DataFrame.union, counts)


on_tables("scan_relations")(row_counts)


def row_digests(t: Tables) -> DataFrame:
    """Number and content of every relation: a sum over hashes of its rows' fixed columns."""
    digests = []
    for name in SCHEMAS:
        parts = [F.coalesce(_shown(f), F.lit("-")) for f in SCHEMAS[name] if f.name not in UNTOLD]
        row = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10)
        total = F.sum(row.cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
        figures = t[name].agg(F.count(F.lit(1)).alias("n_rows"), total.alias("digest"))
        digests.append(figures.select(F.lit(name).alias("relation"), "n_rows", "digest"))
    return reduce(DataFrame.union, digests)


# Columns that hold the time of the load, or that no test table fills.
UNTOLD = (
    "password", "created_at", "enrollment_date", "total_problems_attempted", "expertise_area",
    "problems_created", "admin_level", "description",
)


def _shown(field) -> Column:
    """A value as both engines write it."""
    kind = field.dataType.typeName()
    if kind == "timestamp_ntz":
        return F.date_format(field.name, "yyyy-MM-dd HH:mm:ss")
    return F.col(field.name).cast("string")


@on_session("load_snapshot")
def load_snapshot(spark, sf_dir):
    path = shared_folder(spark, "snapshot")
    tables.write_snapshot(binding.bind(spark, sf_dir), path)
    return row_digests(tables.load(spark, path))


@on_session("assign_identity")
def assign_identity(spark, sf_dir):
    new = binding.raw(spark, sf_dir, "documents").select("doc_id", "source")
    existing = binding.bind(spark, sf_dir).problem
    return tables.assign_ids(new, existing, "problem_id", ["doc_id"])


@on_session("apply_defaults")
def apply_defaults(spark, sf_dir):
    turn = F.col("turn").cast("string")
    given = binding.raw(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("user_id"),
        F.concat(F.col("role"), F.lit(" "), turn).alias("name"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn).alias("email"),
        F.when(F.col("role") == "system", "banned").alias("status"),
    )
    return tables.with_defaults(given, "user", F.expr(NOW))


@on_session("view_performance")
def view_performance(spark, sf_dir):
    tables.register(spark, binding.bind(spark, sf_dir))
    return spark.sql("SELECT * FROM studentperformancesummary WHERE total_attempts > 0")


@on_session("view_activity")
def view_activity(spark, sf_dir):
    tables.register(spark, binding.bind(spark, sf_dir))
    return spark.sql("SELECT * FROM mentoractivitydashboard WHERE problems_created > 0")


@on_session("register_views")
def register_views(spark, sf_dir):
    tables.register(spark, binding.bind(spark, sf_dir))
    return spark.sql(
        "SELECT p.difficulty, count(*) AS problems, sum(s.total_attempts) AS topic_attempts, "
        "max(s.students_attempted) AS most_students "
        "FROM problemstatistics s JOIN problem p ON p.problem_id = s.problem_id "
        "GROUP BY p.difficulty"
    )


@on_tables("result_as_strings")
def result_as_strings(t):
    third = (F.col("score").cast("double") / 3).alias("third")
    good = (F.col("score") >= 60).alias("good")
    return tables.as_text(t.attempt.select("*", third, good))


# --- saved questions and views

on_tables("students_without_attempts")(reports.students_without_attempts)
on_tables("problems_by_mentor")(lambda t: reports.problems_by_mentor(t, "Supplier#000000001"))
on_tables("problem_count_by_difficulty")(reports.problem_count_by_difficulty)
on_tables("top_students")(reports.top_students)
on_tables("best_score_per_problem")(reports.best_score_per_problem)
on_tables("first_attempt_failures")(lambda t: reports.first_attempt_failures(t, ratio=0.002))
on_tables("scenario_score_by_difficulty")(reports.scenario_score_by_difficulty)
on_tables("notification_counts")(reports.notification_counts)
on_tables("student_performance")(reports.student_performance)
on_tables("problem_statistics")(reports.problem_statistics)
on_tables("problem_statistics_clean")(lambda t: reports.problem_statistics(t, faithful=False))
on_tables("mentor_activity")(reports.mentor_activity)

# --- learner side

on_tables("student_summary")(learner.student_summary)
on_tables("recent_attempts")(learner.recent_attempts)
on_tables("recommend_problems")(learner.recommend_problems)
on_tables("problems_passed")(learner.problems_passed)
on_tables("browse_problems")(learner.browse_problems)
on_tables("browse_problems_filtered")(
    lambda t: learner.browse_problems(t, 7, "Easy", "SMALL", "no", "normal")
)
on_tables("browse_problems_attempted")(lambda t: learner.browse_problems(t, 7, attempted="yes"))
on_tables("topic_list")(learner.topic_list)
on_tables("problem_attempts")(learner.problem_attempts)
on_tables("latest_score")(learner.latest_score)
on_tables("my_attempts")(learner.my_attempts)

RANGE = dict(
    date_from="1997-01-01", date_to="1999-12-31", score_min=50, score_max=90, difficulty="Easy"
)
on_tables("my_attempts_filtered")(lambda t: learner.my_attempts(t, has_feedback="no", **RANGE))
on_tables("my_attempts_local_dates")(
    lambda t: learner.my_attempts(
        t, date_from="1997-01-01", date_to="1999-12-31", has_feedback="yes",
        zone="America/Los_Angeles",
    )
)
on_tables("my_attempt_stats")(learner.my_attempt_stats)
on_tables("my_attempt_stats_filtered")(
    lambda t: learner.my_attempt_stats(t, has_feedback="yes", **RANGE)
)
on_tables("attempt_outcomes")(
    lambda t: learner.attempt_outcomes(t, status="Failed", sort="score_asc")
)
on_tables("outcome_counts")(learner.outcome_counts)
on_tables("scenario_list")(learner.scenario_list)
on_tables("scenario_rank")(learner.scenario_rank)

# --- mentor side

on_tables("mentor_summary")(mentor.mentor_summary)
on_tables("pending_reviews")(mentor.pending_reviews)
on_tables("pending_reviews_blank")(lambda t: mentor.pending_reviews(t, blank_is_pending=True))
on_tables("recent_problems")(mentor.recent_problems)
on_tables("feedback_given")(mentor.feedback_given)
on_tables("my_problems")(mentor.my_problems)
on_tables("my_problems_filtered")(
    lambda t: mentor.my_problems(
        t, difficulty="Easy", topic="small", date_from="2024-02-01", date_to="2024-10-31",
        min_attempts=20, max_attempts=35,
    )
)
on_tables("problem_analytics")(mentor.problem_analytics)
on_tables("recent_attempts_of_problem")(mentor.recent_attempts_of_problem)
on_tables("review_attempts")(mentor.review_attempts)
on_tables("review_attempts_filtered")(
    lambda t: mentor.review_attempts(t, has_feedback="yes", score_min=50, score_max=90)
)
on_tables("my_resources")(mentor.my_resources)
on_tables("resource_analytics")(mentor.resource_analytics)
on_tables("resource_totals")(mentor.resource_totals)
on_tables("hardest_problems")(mentor.hardest_problems)
on_tables("repeat_failers")(mentor.repeat_failers)
on_tables("topic_average")(lambda t: mentor.topic_average(t, "small"))

# --- administration and notifications

on_tables("user_directory")(admin.user_directory)
on_tables("user_directory_filtered")(
    lambda t: admin.user_directory(t, role="student", status="banned", search="CUSTOMER#")
)
on_tables("user_totals")(admin.user_totals)
on_tables("inbox")(admin.inbox)
on_tables("notification_receivers")(admin.notification_receivers)


@on_tables("audience")
def audience(t):
    rules = [r for r in admin.AUDIENCES if r != "specific"]
    sets = [admin.audience(t, r).select(F.lit(r).alias("rule"), "user_id") for r in rules]
    return reduce(DataFrame.union, sets)


@on_tables("deliver")
def deliver(t):
    """One announcement per group, and every alert without sender to its user."""
    alerts = t.notification.join(t.send, "noti_id", "left_anti").join(t.receive, "noti_id")
    one = alerts.select("noti_id", F.lit("specific").alias("rule"), F.col("receiver_id").alias("user_id"))
    levels = F.explode(F.array(*map(F.lit, admin.AUDIENCES[:3]))).alias("rule")
    wide = t.notification.agg(F.max("noti_id").alias("last")).select("last", levels)
    wide = wide.select(F.col("last") + F.length("rule"), "rule", F.lit(None).cast("long"))
    return admin.deliver(t, one.union(wide))


@on_tables("send_notification")
def send_notification(t):
    sent, by, got = admin.send_notification(t, ADMINS, "all_mentors", now=F.expr(NOW))
    return got.join(sent, "noti_id").join(by, "noti_id")


# --- scoring


def sql_texts(t: Tables) -> DataFrame:
    """Submitted texts, right answers and candidate queries with an id each."""
    line = F.concat_ws("-", F.lit("try"), "student_id", "problem_id", "line_no")
    return (
        t.submissions.select(line.alias("text_id"), F.col("student_sql").alias("sql"))
        .union(t.problem.select(F.concat_ws("-", F.lit("answer"), "problem_id"), "correct_answer"))
        .union(t.questions.select("question_id", "sql"))
    )


def line(items) -> Column:
    return F.array_join(items, "|")


@on_tables("normalize_sql_text")
def normalize_sql_text(t):
    return sql_texts(t).select("text_id", sqltext.normalize_sql_text(F.col("sql")).alias("normal"))


def clauses(t: Tables) -> DataFrame:
    return sql_texts(t).select("text_id", sqltext.split_clauses(F.col("sql")).alias("c"))


@on_tables("split_clauses")
def split_clauses(t):
    return clauses(t).select(
        "text_id",
        F.col("c.select").alias("select_part"),
        F.col("c.from").alias("from_part"),
        F.col("c.where").alias("where_part"),
    )


@on_tables("extract_tables")
def extract_tables(t):
    return clauses(t).select("text_id", line(sqltext.extract_tables(F.col("c.from"))).alias("found"))


@on_tables("extract_columns")
def extract_columns(t):
    found = line(sqltext.extract_columns(F.col("c.select")))
    return clauses(t).select("text_id", found.alias("found"))


@on_tables("extract_conditions")
def extract_conditions(t):
    found = line(sqltext.extract_conditions(F.col("c.where")))
    return clauses(t).select("text_id", found.alias("found"))


@on_tables("set_f1")
def set_f1(t):
    topics = t.have_topic.groupBy("problem_id").agg(F.collect_set("topic_name").alias("topics"))
    words = t.problem.select("problem_id", F.split("title", " ").alias("words"))
    both = topics.join(words, "problem_id")
    f1 = sqltext.set_f1(F.col("topics"), F.array_distinct("words"))
    return both.select("problem_id", f1.alias("f1"))


def scored(t: Tables) -> DataFrame:
    return scoring.score_submissions(t.submissions, t.problem)


@on_tables("score_submissions")
def score_submissions(t):
    return scored(t).select(
        "student_id",
        "problem_id",
        "line_no",
        "score",
        "details.is_equal",
        "details.from_ok",
        "details.select_ok",
        "details.where_ok",
        F.col("details.score_breakdown.from").alias("from_points"),
        F.col("details.score_breakdown.select").alias("select_points"),
        F.col("details.score_breakdown.where").alias("where_points"),
        "details.score_breakdown.from_f1",
        "details.score_breakdown.select_f1",
        "details.score_breakdown.where_f1",
    )


# --- quality


def tagged(valid: DataFrame, rejected: DataFrame) -> DataFrame:
    rows = valid.withColumn("reason", F.lit("valid")).unionByName(rejected)
    return rows.groupBy("student_id", "reason").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("attempt_no").alias("numbers")
    )


on_tables("feedback_rule")(lambda t: tagged(*quality.feedback_rule(t.staged)))
on_tables("score_range_rule")(lambda t: tagged(*quality.score_range_rule(t.staged)))
on_tables("key_uniqueness")(quality.all_keys)


@on_session("vocabulary_rule")
def vocabulary_rule(spark, sf_dir):
    forms = binding.uploads(lambda table: binding.raw(spark, sf_dir, table))
    levels = binding.bind(spark, sf_dir).payloads.select("difficulty")
    return quality.vocabulary_rule(forms, "resource").union(
        quality.vocabulary_rule(levels, "problem")
    )


@on_tables("orphan_check")
def orphan_check(t):
    """All parents are whole; foreign rows come with a delta of each kind of child."""
    far = 4 * 10**12
    odd = F.col("student_id") % 5 == 0
    return quality.orphan_check(
        t.replace(
            attempt=t.attempt.withColumns(
                {
                    "problem_id": F.when(odd, F.col("problem_id") + far).otherwise(F.col("problem_id")),
                    "mentor_id": F.when(F.col("attempt_no") == 3, F.col("student_id")).otherwise(F.col("mentor_id")),
                }
            ),
            have_topic=t.have_topic.withColumn(
                "topic_name", F.when(F.col("problem_id") % 7 == 0, F.upper("topic_name")).otherwise(F.col("topic_name"))
            ),
            send=t.send.withColumn("sender_id", F.col("sender_id") + F.when(F.col("noti_id") % 2 == 0, far).otherwise(0)),
        )
    )


def next_attempts(t):
    """A delta: every attempt with the next number, those of each fifth student on foreign problems."""
    far = F.when(F.col("student_id") % 5 == 0, 4 * 10**12).otherwise(0)
    return t.attempt.withColumns(
        {"attempt_no": (F.col("attempt_no") + 1).cast("int"), "problem_id": F.col("problem_id") + far}
    )


@on_tables("delta_keys")
def delta_keys(t):
    """New attempts take numbers that are held."""
    return quality.delta_keys(t, {"attempt": next_attempts(t)})


@on_tables("delta_orphans")
def delta_orphans(t):
    """New attempts on problems that are not there, and new topics of problems, some under new names."""
    topics = t.topic.withColumn("topic_name", F.upper("topic_name"))
    bridge = t.have_topic.withColumn(
        "topic_name", F.when(F.col("problem_id") % 7 == 0, F.upper("topic_name")).otherwise(F.reverse("topic_name"))
    )
    return quality.delta_orphans(t, {"attempt": next_attempts(t), "topic": topics, "have_topic": bridge})


@on_session("required_and_length")
def required_and_length(spark, sf_dir):
    forms = binding.uploads(lambda table: binding.raw(spark, sf_dir, table))
    docs = binding.raw(spark, sf_dir, "documents")
    problems = docs.select(
        F.col("doc_id").alias("problem_id"),
        F.col("doc_id").alias("user_id"),
        F.nullif("source", F.lit("src0")).alias("correct_answer"),
        F.col("text").alias("title"),
        F.when(F.col("lang") == "en", "Easy").otherwise("Difficult").alias("difficulty"),
    )
    return quality.required_and_length(forms, "resource").select(
        F.lit("resource").alias("relation"), F.col("resource_id").alias("id"), "column", "violation"
    ).union(
        quality.required_and_length(problems, "problem").select(
            F.lit("problem"), "problem_id", "column", "violation"
        )
    )


on_tables("read_only_gate")(
    lambda t: quality.read_only_gate(t.questions, "sql").select("question_id", "accepted", "reason")
)
on_tables("read_only_gate_word")(
    lambda t: quality.read_only_gate(t.questions, "sql", "word").select(
        "question_id", "accepted", "reason"
    )
)
on_tables("meaningful_text")(
    lambda t: quality.meaningful_text(t.scenario, "scenario_description").select(
        "scenario_no", "meaningful"
    )
)


def generated(t: Tables):
    return quality.parse_generated(
        t.payloads, "payload", F.col("difficulty"), ["payload_id", "scenario_no"]
    )


on_tables("parse_generated")(lambda t: generated(t)[0])
on_tables("parse_generated_topics")(lambda t: generated(t)[1])
on_tables("parse_generated_refused")(lambda t: generated(t)[2])


@on_session("parse_answer")
def parse_answer(spark, sf_dir):
    chat = binding.raw(spark, sf_dir, "conversations")
    both = F.struct(
        F.concat(F.lit(" SELECT "), F.col("role")).alias("sql"), F.col("text").alias("explanation")
    )
    answer = F.when(F.col("role") == "system", F.col("text")).otherwise(F.to_json(both))
    read = quality.parse_answer(chat.withColumn("answer", answer), "answer")
    return read.select("conv_id", "turn", "sql", "explanation")


# --- keyed writes


def plain_scores(t: Tables) -> DataFrame:
    """Submissions with a stand-in score, to number them apart from the scoring job."""
    return t.submissions.withColumn("score", (F.col("line_no") * 10).cast("decimal(5,2)"))


on_tables("append_attempts")(lambda t: writes.append_attempts(t, plain_scores(t)).attempt)
on_tables("submit_attempts")(lambda t: scoring.submit(t, t.submissions))


def odd_submissions(t: Tables) -> DataFrame:
    """Submissions of which some are blank and some name a problem that is not there."""
    line = F.col("line_no")
    return t.submissions.withColumns(
        {
            "student_sql": F.when(line == 5, F.lit(" \n")).otherwise(F.col("student_sql")),
            "problem_id": F.when(line == 6, F.col("problem_id") + 4 * 10**12).otherwise(F.col("problem_id")),
        }
    )


@on_tables("take_submissions")
def take_submissions(t):
    """Figures per student after the insert: attempts, best score, notices, and refusals by reason."""
    after, refused = scoring.take_submissions(t, odd_submissions(t), F.expr(NOW))
    tried = after.attempt.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("score").cast("decimal(20,2)").alias("points"),
        F.sum("attempt_no").alias("numbers"),
    )
    told = after.receive.groupBy(F.col("receiver_id").alias("student_id")).agg(
        F.count(F.lit(1)).alias("notices")
    )
    lost = refused.groupBy("student_id").agg(
        F.count_if(F.col("reason") == "no answer").alias("blank"),
        F.count_if(F.col("reason") == "unknown problem").alias("unknown"),
    )
    figures = tried.join(told, "student_id", "left").join(lost, "student_id", "left")
    return figures.na.fill(0, ["notices", "blank", "unknown"])


def reviews(t: Tables) -> DataFrame:
    """A review of every attempt: by the author or by the attempt's mentor, some without text."""
    author = t.problem.select("problem_id", F.col("user_id").alias("author"))
    text = F.when(F.col("attempt_no") == 2, "  ").otherwise(
        F.concat(F.lit(" seen "), F.col("problem_id").cast("string"))
    )
    return t.attempt.join(author, "problem_id").select(
        "student_id",
        "problem_id",
        "attempt_no",
        F.coalesce("mentor_id", "author").alias("mentor_id"),
        text.alias("feedback"),
        F.col("submit_time").alias("sent_at"),
    )


on_tables("apply_feedback")(lambda t: writes.apply_feedback(t, reviews(t)).attempt)


@on_session("upsert_topics")
def upsert_topics(spark, sf_dir):
    t = binding.bind(spark, sf_dir)
    names = F.array(F.concat(F.lit(" "), "p_type"), F.col("p_brand"), F.lit("  "), F.col("p_brand"))
    pairs = binding.raw(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("problem_id"), F.explode(names).alias("topic_name")
    )
    merged = writes.upsert_topics(t, pairs, now=F.expr(NOW))
    names = merged.topic.select(F.lit(None).cast("long").alias("problem_id"), "topic_name")
    return names.union(merged.have_topic.select("problem_id", "topic_name"))


def with_drafts(t: Tables) -> Tables:
    """The platform with a draft beside every fourth problem and for every scenario: nobody tried those."""
    far = F.lit(DRAFTS)
    copies = t.problem.filter("problem_id % 4 = 0").withColumn("problem_id", F.col("problem_id") + far)
    copies = copies.withColumn("scenario_no", F.lit(None).cast("long"))
    owner = F.lit(MENTORS) + F.col("scenario_no") % 2
    own = t.scenario.select(
        (F.col("scenario_no") + 2 * far).alias("problem_id"), owner.alias("user_id"),
        F.lit("SELECT 1").alias("correct_answer"), F.col("created_at").alias("create_time"),
        F.concat(F.lit("Draft "), F.col("scenario_no").cast("string")).alias("title"),
        F.lit("Easy").alias("difficulty"), "scenario_no", F.lit(None).cast("string").alias("description"),
    )
    return t.replace(problem=t.problem.unionByName(copies).unionByName(own))


# Ids of drafts are moved by this.
DRAFTS = 10**13


def problem_requests(t: Tables) -> DataFrame:
    """Each problem's removal, asked for by its author or, for Hard ones, by the first mentor."""
    by = F.when(F.col("difficulty") == "Hard", F.lit(MENTORS)).otherwise(F.col("user_id"))
    return t.problem.select(by.alias("mentor_id"), "problem_id")


on_tables("guarded_delete_problem")(
    lambda t: writes.problem_delete_outcomes(with_drafts(t), problem_requests(with_drafts(t)))
)


@on_tables("guarded_delete_problem_left")
def guarded_delete_problem_left(t):
    t = with_drafts(t)
    left = writes.guarded_delete_problem(t, problem_requests(t))
    return left.problem.select("problem_id").join(left.have_topic, "problem_id", "left")


def scenario_requests(t: Tables) -> DataFrame:
    return t.scenario.select("student_id", "scenario_no")


on_tables("guarded_delete_scenario")(
    lambda t: writes.scenario_delete_outcomes(with_drafts(t), scenario_requests(t))
)


@on_tables("guarded_delete_scenario_left")
def guarded_delete_scenario_left(t):
    t = with_drafts(t)
    left = writes.guarded_delete_scenario(t, scenario_requests(t))
    kept = left.scenario.select(F.lit("scenario").alias("relation"), F.col("scenario_no").alias("id"))
    return kept.union(left.problem.select(F.lit("problem"), "problem_id"))


def banned(t: Tables) -> DataFrame:
    return t.user.filter("status = 'banned'").select("user_id")


def settled_attempts(t: Tables) -> Tables:
    """The platform with its attempts written, as a cascade reads them three times."""
    return t.replace(attempt=written(t.attempt, "attempts"))


@on_tables("cascade_delete_user")
def cascade_delete_user(t):
    """Number and content of what is left of every relation; users with tried problems stay."""
    return row_digests(writes.cascade_delete_user(settled_attempts(t), banned(t)))


on_tables("cascade_delete_attempts")(
    lambda t: writes.cascade_delete_user(settled_attempts(t), banned(t)).attempt.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("mentor_id").alias("marked")
    )
)
on_tables("deletable_users")(lambda t: writes.deletable_users(t, banned(t)))
on_tables("cascade_delete_all")(lambda t: row_digests(writes.cascade_delete_user(settled_attempts(t), banned(t), guard=False)))


def followed(t: Tables) -> tuple[Tables, kept.Kept]:
    """The platform after submissions, reviews and the removal of banned users, with counts that followed the changes."""
    # Each version of the attempts is written, dealt out by student like the counts, for the jobs that follow.
    attempts = deal(t.attempt, "attempts", "student_id", writes.ATTEMPT)
    t = t.replace(attempt=attempts.rows())
    counts = kept.build(t)
    attempts = attempts.add(writes.number_attempts(t, plain_scores(t), dealt=True))
    changes = kept.added(attempt=attempts.last())
    t = t.replace(attempt=attempts.rows())
    accepted = writes.accepted_feedback(t, reviews(t), dealt=True)
    rows = deal(writes.reviewed(t, accepted), "reviewed-attempts", "student_id", writes.ATTEMPT).rows()
    changes = kept.together(changes, kept.feedback_changes(t, accepted, rows))
    t, counts = writes.with_feedback(t, accepted, rows), kept.settled(kept.fold(counts, changes))
    removal = writes.plan_removal(t, banned(t), guard=False)
    return writes.without_removed(t, removal), kept.fold(counts, kept.removal_changes(t, removal))


on_tables("kept_performance")(lambda t: kept.student_performance(*followed(t)))
on_tables("kept_statistics")(lambda t: kept.problem_statistics(*followed(t)))
on_tables("kept_activity")(lambda t: kept.mentor_activity(*followed(t)))
on_tables("dismiss_notification")(
    lambda t: writes.dismiss_notification(
        t, t.receive.join(t.send.select("noti_id"), "noti_id", "left_semi")
    ).receive
)


def status_changes(t: Tables) -> DataFrame:
    """Every user is unbanned once; those who got an alert from an admin are then banned."""
    first = t.user.select("user_id", F.lit("unban").alias("action"), F.lit(1).alias("sent_at"))
    told = t.receive.join(t.send.select("noti_id"), "noti_id", "left_semi").select(
        F.col("receiver_id").alias("user_id")
    )
    return first.union(told.distinct().select("user_id", F.lit("ban"), F.lit(2)))


on_tables("set_status")(
    lambda t: writes.set_status(t, status_changes(t)).user.select("user_id", "status")
)


def edits(t: Tables) -> DataFrame:
    """Each student asks for a new name, and for an e-mail shared by two or held by a mentor.

    Every second one had asked for something else before.
    """
    key = F.col("user_id")
    email = (
        F.when(key % 3 == 0, F.concat(F.lit(" pair"), F.floor(key / 2).cast("string"), F.lit("@example.com ")))
        .when(key % 3 == 1, F.lit("supplier.000000001@example.com"))
    )
    last = t.student.select(
        "user_id",
        F.concat(F.lit(" Learner "), key.cast("string")).alias("name"),
        email.alias("email"),
        F.when(key % 2 == 0, "banned").otherwise("odd").alias("status"),
        F.when(key % 5 == 0, "plain").otherwise("").alias("password"),
        F.lit(2).alias("sent_at"),
    )
    first = last.filter(key % 2 == 0).withColumns({"name": F.lit("Early"), "email": F.lit(None).cast("string"), "sent_at": F.lit(1)})
    return last.unionByName(first)


on_tables("edit_users")(
    lambda t: writes.edit_users(t, edits(t)).user.select("user_id", "name", "email", "status")
)
on_tables("edit_outcomes")(
    lambda t: writes.edit_outcomes(t, edits(t)).select("user_id", "outcome")
)


def problem_edits(t: Tables) -> DataFrame:
    """Every author renames each problem twice; Hard ones are asked for by another mentor, some lack an answer."""
    key = F.col("problem_id")
    by = F.when(F.col("difficulty") == "Hard", F.lit(MENTORS) - 1).otherwise(F.col("user_id"))
    turns = F.explode(F.array(F.lit(1), F.lit(2))).alias("sent_at")
    asked = t.problem.select(by.alias("mentor_id"), "problem_id", "difficulty", turns)
    return asked.select(
        "mentor_id", "problem_id", "sent_at",
        F.concat(F.lit(" Edit "), F.col("sent_at").cast("string"), F.lit(" ")).alias("title"),
        F.when((key % 3 == 0) & (F.col("sent_at") == 2), " ").otherwise("SELECT 2").alias("correct_answer"),
        F.lit("changed").alias("description"), F.when(key % 2 == 0, "Medium").alias("difficulty"),
    )


on_tables("problem_edit_outcomes")(
    lambda t: writes.problem_edit_outcomes(t, problem_edits(t)).select("mentor_id", "problem_id", "sent_at", "outcome")
)
on_tables("edit_problems")(
    lambda t: writes.edit_problems(t, problem_edits(t)).problem.select(
        "problem_id", "title", "correct_answer", "difficulty", "description"
    )
)


@on_session("register_users")
def register_users(spark, sf_dir):
    """Users and their roles after requests made from documents: few fields, shared e-mails."""
    t = binding.bind(spark, sf_dir)
    lang, source = F.col("lang"), F.col("source")
    role = F.when(lang == "en", "student").when(lang == "fr", "mentor").when(lang == "de", "admin")
    email = F.when(source == "src1", "supplier.000000001@example.com").otherwise(
        F.concat(lang, F.lit("-"), "n_chars", F.lit("@example.com "))
    )
    requests = binding.raw(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.when(source != "src0", F.concat(F.lit(" "), source)).alias("name"),
        email.alias("email"),
        F.when(F.col("n_chars") % 7 == 0, "plain").otherwise(F.lit("pbkdf2$1$c2FsdA$aGFzaA")).alias("password"),
        F.coalesce(role, F.lit("guest")).alias("role"),
    )
    after = writes.register_users(t, requests, F.expr(NOW))
    return admin.roles(after).select("user_id", "name", "email", "role", "status")


on_tables("add_generated")(
    lambda t: writes.add_generated(t, t.payloads, MENTORS, F.expr(NOW)).problem.select(
        "problem_id", "user_id", "scenario_no", "title", "difficulty", "correct_answer"
    )
)
on_tables("add_generated_topics")(
    lambda t: writes.add_generated(t, t.payloads, MENTORS, F.expr(NOW)).have_topic
)


@on_session("read_only_query")
def read_only_query(spark, sf_dir):
    sql = (
        "SELECT p.difficulty, count(*) AS attempts, max(a.score) AS best, min(a.feedback) AS note "
        "FROM attempt a JOIN problem p ON p.problem_id = a.problem_id GROUP BY p.difficulty"
    )
    return questions.ask(spark, binding.bind(spark, sf_dir), sql)


# --- alerts and counters, batch and stream


@on_tables("high_score_alerts")
def high_score_alerts(t):
    sent, got = writes.high_score_alerts(t, t.attempt, now=F.expr(NOW))
    return got.join(sent, "noti_id").select("noti_id", "receiver_id", "send_time")


on_tables("running_problem_counts")(lambda t: writes.running_problem_counts(t.problem))


def raw_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reader = spark.readStream.schema(binding.RAW[table])
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def attempt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.attempts(
        raw_stream(spark, sf_dir, "lineitem"), binding.raw(spark, sf_dir, "orders")
    )


@on_session("stream_high_score_alerts")
def stream_high_score_alerts(spark, sf_dir):
    out = shared_folder(spark, "alerts")
    known = binding.bind(spark, sf_dir).notification
    query = streams.high_score_stream(
        attempt_stream(spark, sf_dir), known, f"{out}/out", f"{out}/state", now=F.expr(NOW)
    )
    query.awaitTermination()
    sent, got = streams.read_alerts(spark, f"{out}/out")
    return got.join(sent, "noti_id").select("noti_id", "receiver_id", "send_time")


@on_session("stream_problem_counts")
def stream_problem_counts(spark, sf_dir):
    out = shared_folder(spark, "counts")
    parts = raw_stream(spark, sf_dir, "part")
    stream = binding.problems(
        lambda table: parts if table == "part" else binding.raw(spark, sf_dir, table)
    )
    streams.problem_count_stream(stream, f"{out}/out", f"{out}/state").awaitTermination()
    return streams.read_problem_counts(spark, f"{out}/out")


@on_session("stream_quality_gate")
def stream_quality_gate(spark, sf_dir):
    out = shared_folder(spark, "gate")
    lines = raw_stream(spark, sf_dir, "lineitem")
    stream = binding.staged(
        lambda table: lines if table == "lineitem" else binding.raw(spark, sf_dir, table)
    )
    streams.stream_quality_gate(stream, f"{out}/out", f"{out}/state").awaitTermination()
    judged = streams.read_gate(spark, f"{out}/out")
    return judged.groupBy("student_id", "outcome").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("attempt_no").alias("numbers")
    )


@on_session("stream_attempt_numbering")
def stream_attempt_numbering(spark, sf_dir):
    """Lines arrive in three parts, by year, each part as the stream's next micro-batch."""
    out = shared_folder(spark, "numbers")
    known = binding.bind(spark, sf_dir).attempt
    lines = binding.raw(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    for part in (year < 1994, year.isin(1994, 1995), (year > 1995) | year.isNull()):
        lines.filter(part).write.mode("append").parquet(f"{out}/lines")
        arrived = spark.readStream.schema(binding.RAW["lineitem"]).parquet(f"{out}/lines")
        stream = binding.attempts(arrived, binding.raw(spark, sf_dir, "orders"))
        streams.numbering_stream(stream, f"{out}/out", f"{out}/state", known).awaitTermination()
    return streams.read_numbered(spark, f"{out}/out")


# --- shared expressions


@on_tables("score_labels")
def score_labels(t):
    score = F.col("score")
    marked = t.attempt.select(
        exprs.score_band(score).alias("band"),
        exprs.score_tier(score).alias("tier"),
        exprs.display_date(F.col("submit_time")).alias("shown"),
    )
    return marked.groupBy("band", "tier", "shown").agg(F.count(F.lit(1)).alias("n_rows"))


@on_tables("short_texts")
def short_texts(t):
    text = F.col("scenario_description")
    return t.scenario.select(
        "scenario_no",
        exprs.first_words(text, 30).alias("preview"),
        exprs.first_chars(text).alias("start"),
    )
