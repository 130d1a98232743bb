"""Keyed writes on the small platform, against what each rule says by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from classmeter.operators import admin, questions, scoring, writes
from conftest import rows
from seed import ATTEMPTS

T0 = datetime.datetime(2024, 5, 1, 8, 0)
HASH = "pbkdf2$1$c2FsdA$aGFzaA"


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "user_id long")


def test_append_numbers_go_on(spark, seed):
    later = lambda m: T0 + datetime.timedelta(minutes=m)
    batch = [(1, 101, 70.0, later(5)), (1, 101, 80.0, later(1)), (1, 106, 50.0, later(2)), (1, 101, 90.0, later(4_000))]
    frame = spark.createDataFrame(batch, "student_id long, problem_id long, score double, submit_time timestamp_ntz")
    new = rows(writes.number_attempts(seed, frame))
    assert sorted((r[0], r[1], r[2], float(r[4])) for r in new) == [
        (1, 101, 3, 80.0), (1, 101, 4, 70.0), (1, 101, 5, 90.0), (1, 106, 1, 50.0),
    ]
    assert all(r[3] is None and r[6] is None for r in new)
    assert writes.append_attempts(seed, frame).attempt.count() == len(ATTEMPTS) + 4


def test_submissions_as_one_job(spark, seed):
    frame = spark.createDataFrame(
        [(1, 101, "SELECT 1", T0), (1, 101, "  ", T0), (2, 101, "SELECT 2", T0), (3, 999, "SELECT 1", T0), (6, 107, "select 1;", T0)],
        "student_id long, problem_id long, student_sql string, submit_time timestamp_ntz",
    )
    new = rows(scoring.submit(seed, frame))
    scored = [(1, 101, 3, 100.0), (2, 101, 2, 70.0), (6, 107, 1, 100.0)]
    assert sorted((r[0], r[1], r[2], float(r[4])) for r in new) == scored
    after, refused = scoring.take_submissions(seed, frame)
    assert sorted(rows(refused)) == [(1, 101, "no answer"), (3, 999, "unknown problem")]
    assert after.attempt.count() == len(ATTEMPTS) + 3
    told = after.receive.join(seed.receive, ["receiver_id", "noti_id"], "left_anti")
    assert sorted(rows(told)) == [(1, 11), (6, 12)] and after.notification.count() == 12


def test_a_refused_score_uses_up_no_number(spark, seed, monkeypatch):
    odd = F.when(F.col("student_sql") == "bad", 120.0).otherwise(70.0)
    monkeypatch.setattr(scoring, "score_submissions", lambda batch, problem: batch.withColumn("score", odd))
    batch = [(1, 101, "bad", T0), (1, 101, "good", T0 + datetime.timedelta(minutes=1))]
    frame = spark.createDataFrame(batch, "student_id long, problem_id long, student_sql string, submit_time timestamp_ntz")
    after, refused = scoring.take_submissions(seed, frame)
    assert rows(refused) == [(1, 101, "score out of range")]
    assert sorted(r.attempt_no for r in after.attempt.filter("student_id = 1 and problem_id = 101").collect()) == [1, 2, 3]


def test_feedback_needs_owner_and_text(spark, seed):
    updates = [
        (1, 101, 1, 21, " fine ", T0), (1, 101, 1, 21, "older", T0 - datetime.timedelta(1)),
        (2, 101, 1, 22, "not mine", T0), (3, 101, 1, 21, "  ", T0), (4, 104, 1, 22, "again", T0),
    ]
    frame = spark.createDataFrame(
        updates, "student_id long, problem_id long, attempt_no int, mentor_id long, feedback string, sent_at timestamp_ntz"
    )
    after = {r[:3]: (r[3], r[6]) for r in rows(writes.apply_feedback(seed, frame).attempt)}
    before = {r[:3]: (r[3], r[6]) for r in rows(seed.attempt)}
    changed = {k: v for k, v in after.items() if before[k] != v}
    assert changed == {(1, 101, 1): (21, "fine"), (4, 104, 1): (22, "again")} and len(after) == len(ATTEMPTS)


def test_upsert_topics(spark, seed):
    pairs = spark.createDataFrame(
        [(101, " basics "), (101, "New"), (102, "New"), (102, ""), (102, "New ")], "problem_id long, topic_name string"
    )
    topics, bridge = writes.new_topics(seed, pairs)
    assert [r[0] for r in rows(topics)] == ["New"]
    assert sorted(rows(bridge)) == [(101, "New"), (102, "New")]
    merged = writes.upsert_topics(seed, pairs)
    assert merged.topic.count() == 5 and merged.have_topic.count() == 10


def test_guarded_deletes(spark, seed):
    # 106 and 107 are untried
    asked = spark.createDataFrame([(21, 106), (21, 107), (21, 101), (21, 99), (22, 107), (21, 106)], "mentor_id long, problem_id long")
    outcomes = {r[:2]: r[2] for r in rows(writes.problem_delete_outcomes(seed, asked))}
    assert outcomes == {
        (21, 106): "deleted", (21, 107): "not found", (21, 101): "refused", (21, 99): "not found", (22, 107): "deleted",
    }
    left = writes.guarded_delete_problem(seed, asked)
    assert sorted(r.problem_id for r in left.problem.collect()) == [101, 102, 103, 104, 105]
    assert left.have_topic.filter("problem_id > 105").count() == 0

    t = seed.replace(attempt=seed.attempt.filter("problem_id <> 104"))
    asked = spark.createDataFrame([(2, 503), (1, 501), (2, 502), (4, 504)], "student_id long, scenario_no long")
    outcomes = {r[1]: r[2] for r in rows(writes.scenario_delete_outcomes(t, asked))}
    assert outcomes == {503: "deleted", 501: "refused", 502: "not found", 504: "deleted"}
    left = writes.guarded_delete_scenario(t, asked)
    assert sorted(r.scenario_no for r in left.scenario.collect()) == [501, 502]
    assert left.problem.filter("problem_id = 104").count() == 0 and left.problem.count() == 6
    assert left.have_topic.filter("problem_id = 104").count() == 0


def test_a_cascade_is_guarded(spark, seed):
    # 23 wrote 105, which was tried; 24 wrote nothing; 1 is a student
    asked = ids(spark, 1, 23, 24)
    assert sorted(rows(writes.deletable_users(seed, asked))) == [(1,), (24,)]
    left = writes.cascade_delete_user(seed, asked)
    assert sorted(r.user_id for r in left.mentor.collect()) == [21, 22, 23]
    assert left.attempt.filter("student_id = 1").count() == 0 and left.attempt.count() == 9
    # scenarios 501 and 502 go with student 1; 101, 103 and 106 lose theirs and stay
    kept = {r.problem_id: r.scenario_no for r in left.problem.collect()}
    assert kept == {101: None, 102: None, 103: None, 104: 503, 105: None, 106: None, 107: None}
    assert sorted(rows(left.receive)) == [(2, 2), (3, 3), (4, 4), (5, 5)]
    assert rows(left.access.select("resource_id", "student_id")) == [(301, 2)]


def test_a_cascade_without_guard(spark, seed):
    left = writes.cascade_delete_user(seed, ids(spark, 23, 41), guard=False)
    count = lambda name: left[name].count()
    assert (count("user"), count("mentor"), count("admin"), count("problem"), count("resource")) == (11, 3, 2, 6, 3)
    assert left.attempt.filter("problem_id = 105").count() == 0 and count("attempt") == 10
    assert rows(left.send) == [(42, 8)] and count("receive") == 6


def test_a_cascade_clears_the_reviewer(spark, seed):
    own = seed.problem.withColumn("user_id", F.lit(24).cast("long"))
    left = writes.cascade_delete_user(seed.replace(problem=own), ids(spark, 21))
    assert left.attempt.count() == len(ATTEMPTS)
    reviewers = sorted(r.mentor_id for r in left.attempt.collect() if r.mentor_id)
    assert reviewers == [22, 22, 23]


def test_dismiss(spark, seed):
    pairs = spark.createDataFrame([(1, 1), (2, 99)], "receiver_id long, noti_id long")
    assert writes.dismiss_notification(seed, pairs).receive.count() == 5


def test_status_changes(spark, seed):
    changes = spark.createDataFrame(
        [(1, "ban", 1), (1, "unban", 2), (2, "ban", 1), (3, "hide", 1)], "user_id long, action string, sent_at int"
    )
    status = dict(rows(writes.set_status(seed, changes).user.select("user_id", "status")))
    assert [u for u, s in status.items() if s == "banned"] == [2]


EDIT = "user_id long, name string, email string, status string, password string, sent_at int"


def test_user_edits(spark, seed):
    edits = [
        (1, " New ", "", "banned", "", 1), (2, "", "p3@example.com", "", "", 1), (3, None, "p3@example.com", "odd", HASH, 1),
        (4, "A", "same@example.com", None, None, 1), (5, "B", " same@example.com", None, None, 1), (99, "x", None, None, None, 1),
        (6, "C", None, None, "plain text", 1),
    ]
    frame = spark.createDataFrame(edits, EDIT)
    outcomes = {r.user_id: r.outcome for r in writes.edit_outcomes(seed, frame).collect()}
    assert outcomes == {
        1: "changed", 2: "email in use", 3: "changed", 4: "changed", 5: "email in use", 99: "not found", 6: "password not hashed",
    }
    users = {r[0]: r[1:5] for r in rows(writes.edit_users(seed, frame).user)}
    assert users[1] == ("New", "p1@example.com", "x", "banned")
    assert users[3] == ("Person 03", "p3@example.com", HASH, "active")
    assert users[4][1] == "same@example.com" and users[5][:2] == ("Person 05", "p5@example.com")


def test_the_last_edit_of_a_user_counts(spark, seed):
    edits = [(1, "first", None, None, None, 1), (1, "last", None, None, None, 3), (1, "middle", "m@example.com", None, None, 2),
             (2, "a", None, None, None, 1), (2, "b", None, None, None, 1), (2, "b", None, None, None, 1)]
    frame = spark.createDataFrame(edits, EDIT)
    after = rows(writes.edit_users(seed, frame).user.select("user_id", "name", "email"))
    assert len(after) == 13
    assert dict((r[0], r[1:]) for r in after)[1] == ("last", "p1@example.com")
    assert dict((r[0], r[1:]) for r in after)[2][0] == "b"
    outcomes = sorted((r.user_id, r.name, r.outcome) for r in writes.edit_outcomes(seed, frame).collect())
    assert outcomes == [(1, "first", "superseded"), (1, "last", "changed"), (1, "middle", "superseded"),
                        (2, "a", "superseded"), (2, "b", "changed")]


def test_problem_edits(spark, seed):
    edits = [
        (21, 101, " Title ", "d", "SELECT 9", "Hard", 1), (21, 101, "Last", None, "SELECT 8", None, 2), (21, 101, "Bad", "", " ", "Easy", 3),
        (22, 102, "Not mine", "", "SELECT 1", "Easy", 1), (21, 999, "None", "", "SELECT 1", "Easy", 1),
    ]
    frame = spark.createDataFrame(
        edits, "mentor_id long, problem_id long, title string, description string, correct_answer string, difficulty string, sent_at int"
    )
    outcomes = {(r.problem_id, r.sent_at): r.outcome for r in writes.problem_edit_outcomes(seed, frame).collect()}
    assert outcomes == {
        (101, 1): "superseded", (101, 2): "changed", (101, 3): "missing field", (102, 1): "not found", (999, 1): "not found",
    }
    after = {r.problem_id: r for r in writes.edit_problems(seed, frame).problem.collect()}
    assert (after[101].title, after[101].correct_answer, after[101].difficulty) == ("Last", "SELECT 8", "Easy")
    assert after[102].title == "Problem 102" and len(after) == 7


def test_directory_and_notifications(spark, seed):
    roles = {r[0]: r[3] for r in rows(admin.user_directory(seed))}
    assert (roles[1], roles[21], roles[41]) == ("student", "mentor", "admin")
    assert [r[0] for r in rows(admin.user_directory(seed, search="PERSON 2"))] == [21, 22, 23, 24]
    assert rows(admin.user_directory(seed, search="n_0")) == []
    blank = seed.replace(user=seed.user.withColumn("status", F.lit("")))
    assert rows(admin.user_totals(blank)) == [(13, 13, 0, 7)]
    seen = [(r[1], r[3], r[4]) for r in rows(admin.inbox(seed, 1))]
    assert seen == [(1, "System", None), (6, "System", None)]
    more = spark.createDataFrame([(21, 1), (3, 7)], "receiver_id long, noti_id long")
    shared = seed.replace(receive=seed.receive.union(more))
    assert [(r[1], r[3], r[4]) for r in rows(admin.inbox(shared, 3))] == [(3, "System", None), (7, "Person 41", 41)]
    asked = rows(admin.notification_receivers(shared, 1, 21))
    assert [(r[1], r[4]) for r in asked] == [(1, 2), (21, 2)]
    assert rows(admin.notification_receivers(shared, 1, 5)) == []
    assert rows(admin.audience(seed, "specific", 5)) == [(5,)]
    assert admin.audience(seed, "all_users").count() == 13
    messages = spark.createDataFrame(
        [(50, "all_mentors", None), (51, "specific", 3), (52, "specific", 999)], "noti_id long, rule string, user_id long"
    )
    assert sorted(rows(admin.deliver(seed, messages))) == [(3, 51), (21, 50), (22, 50), (23, 50), (24, 50)]


def test_registration(spark, seed):
    asked = [
        (1, " Ann ", "a@example.com", HASH, "student"), (2, "Bo", "a@example.com ", HASH, "mentor"),
        (3, "Cy", "p3@example.com", HASH, "admin"), (4, "", "d@example.com", HASH, "admin"),
        (5, "Ed", "e@example.com", HASH, "guest"), (6, "Flo", "f@example.com", HASH, "mentor"),
        (7, "Gus", "g@example.com", None, "admin"), (8, "Hal", "h@example.com", "letmein", "admin"),
    ]
    frame = spark.createDataFrame(asked, "request_id long, name string, email string, password string, role string")
    outcomes = {r.request_id: r.outcome for r in writes.registration_outcomes(seed, frame).collect()}
    assert outcomes == {
        1: "created", 2: "email in use", 3: "email in use", 4: "missing field", 5: "invalid role",
        6: "created", 7: "missing field", 8: "password not hashed",
    }
    after = writes.register_users(seed, frame)
    new = {r.user_id: (r.name, r.role, r.status) for r in admin.roles(after).filter("user_id > 43").collect()}
    assert new == {44: ("Ann", "student", "active"), 45: ("Flo", "mentor", "active")}
    assert after.mentor.filter("user_id = 45").first().expertise_area == "General"


def test_generated_problems(spark, seed):
    item = '{"title": "T%d", "correct_sql": "SELECT %d", "topics": ["joins", "Fresh"]}'
    payloads = [
        (5, 501, '{"problems": [%s, %s]}' % (item % (1, 1), item % (2, 2)), "hard"),
        (4, 502, '{"problems": [%s]}' % (item % (3, 3)), None), (6, 503, "nothing", "Easy"), (7, 99, item % (4, 4), "Easy"),
    ]
    frame = spark.createDataFrame(payloads, "payload_id long, scenario_no long, payload string, difficulty string")
    after = writes.add_generated(seed, frame, 21)
    new = [(r.problem_id, r.title, r.difficulty, r.scenario_no, r.user_id) for r in
           after.problem.filter("problem_id > 107").orderBy("problem_id").collect()]
    assert new == [(108, "T3", "Easy", 502, 21), (109, "T1", "Hard", 501, 21), (110, "T2", "Hard", 501, 21)]
    assert after.have_topic.filter("problem_id > 107").count() == 6 and after.topic.count() == 5


def test_new_message(spark, seed):
    sent, by, got = admin.send_notification(seed, 41, "all_mentors")
    assert [r[0] for r in rows(sent)] == [11] and rows(by) == [(41, 11)]
    assert sorted(rows(got)) == [(m, 11) for m in (21, 22, 23, 24)]
    with pytest.raises(PermissionError):
        admin.send_notification(seed, 1, "all_mentors")
    with pytest.raises(ValueError):
        admin.send_notification(seed, 41, "specific", 999)


def test_ask(spark, seed):
    found = questions.ask(spark, seed, "SELECT max(score) AS best, max(mentor_id) AS m FROM attempt WHERE problem_id = 103")
    assert rows(found) == [("100.00", "22")]
    nested = "SELECT n FROM (SELECT count(*) AS n FROM user u JOIN student s ON s.user_id = u.user_id), topic WHERE topic_name = 'sets'"
    assert rows(questions.ask(spark, seed, nested)) == [("6",)]
    named = "SELECT k FROM attempt JOIN studentperformancesummary ON user_id = student_id, (WITH x AS (SELECT 1 AS k) SELECT * FROM x) y LIMIT 1"
    assert rows(questions.ask(spark, seed, named)) == [("1",)]
    outer = "SELECT k FROM (WITH x AS (SELECT 1 AS k), y AS (SELECT k + 1 AS k FROM x) SELECT * FROM y WHERE k IN (SELECT k + 1 FROM x)) z"
    assert rows(questions.ask(spark, seed, outer)) == [("2",)]
    many = ", ".join(f"c{i} AS (SELECT {i} + (SELECT n FROM c{i - 1}) AS n)" for i in range(1, 40))
    assert rows(questions.ask(spark, seed, f"SELECT n FROM (WITH c0 AS (SELECT 0 AS n), {many} SELECT n FROM c39) x")) == [("780",)]
    lateral = "SELECT count(*) AS n FROM topic t, LATERAL (SELECT t.topic_name AS n FROM topic LIMIT 1) l, range(2)"
    assert rows(questions.ask(spark, seed, lateral)) == [(str(2 * seed.topic.count()),)]


@pytest.fixture
def vault(spark):
    spark.range(1).withColumnRenamed("id", "a").createOrReplaceTempView("vault")
    yield
    spark.catalog.dropTempView("vault")


@pytest.mark.parametrize(
    "sql",
    [
        "select v.a from vault v where exists (with vault as (select 1 as b) select b from vault)",
        "select * from (with vault as (select 1 as b) select b from vault) x, vault v",
        "select * from (with vault as (select * from vault) select * from vault) x",
        "select * from (with x as (select * from y), y as (select 1 as k) select * from x) z",
        "select * from topic t, lateral (select a from vault) l",
        "select (select max(a) from (select a from (select a from vault) p) q) from topic",
        "select * from identifier('vault')",
        "select * from identifier('va' || 'ult') v",
        "select 1 from topic union all select a from vault",
        "select * from topic where topic_name in (select string(a) from vault)",
        "select * from (with " + ", ".join(f"c{i} as (select 1 as n)" for i in range(40)) + " select a from vault) x",
    ],
)
def test_ask_follows_scopes(spark, seed, vault, sql):
    with pytest.raises(PermissionError, match="not a relation"):
        questions.ask(spark, seed, sql)


@pytest.mark.parametrize(
    "sql, reason",
    [
        ("SELECT created_at FROM topic", "write word"),
        ("SHOW TABLES", "not a select"),
        ("SELECT reflect('java.lang.Math', 'abs', -5)", "outside"),
        ("select 1, TRY_REFLECT('java.lang.Math', 'abs', -5) from topic", "outside"),
        ("SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "outside"),
        ("SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "not a relation"),
        ("SELECT * FROM default.topic", "not a relation"),
        ("SELECT (SELECT max(x) FROM elsewhere) FROM topic", "not a relation"),
    ],
)
def test_ask_refuses(spark, seed, sql, reason):
    with pytest.raises(PermissionError, match=reason):
        questions.ask(spark, seed, sql)
