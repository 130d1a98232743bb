"""Gates, rules and checks on known inputs."""

import json
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from classmeter.operators import quality
from classmeter.session import shared_folder
from classmeter.sources import tables
from conftest import rows


def test_read_only_gate(spark):
    texts = [
        ("plain", "select name from student"), ("cte", "with x as (select 1) select * from x"),
        ("column", "select created_at from topic"), ("empty", ""), ("null", None),
        ("tail", "SELECT 1; DROP TABLE t"), ("padded", "  Select 2 "),
    ]
    frame = spark.createDataFrame(texts, "id string, sql string")
    strict = dict(rows(quality.read_only_gate(frame, "sql").select("id", "reason")))
    assert strict == {
        "plain": None, "cte": "not a select", "column": "write word", "empty": "not a select",
        "null": "not a select", "tail": "write word", "padded": None,
    }
    word = dict(rows(quality.read_only_gate(frame, "sql", "word").select("id", "accepted")))
    assert word["column"] is True and word["tail"] is False


def test_meaningful_text(spark):
    texts = [
        "123", "sdf", "123456789", "-----------", "Seaside Cat Cafe", None, "   ab c      ",
        "a b c ......", "日本語 テーブル 1234",
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "d string")
    found = [r.meaningful for r in quality.meaningful_text(frame, "d").collect()]
    assert found == [False, False, False, False, True, False, False, True, True]


def generated(spark, payloads):
    frame = spark.createDataFrame(payloads, "id long, payload string, difficulty string")
    parts = quality.parse_generated(frame, "payload", F.col("difficulty"), ["id"])
    return [sorted(rows(p)) for p in parts]


def test_parse_generated(spark):
    item = lambda **more: {"title": "T", "description": "d", "correct_sql": " SELECT 1 ", "topics": ["x"]} | more
    payloads = [
        (1, '{"problems": []}', "Easy"),
        (2, '{"problems": "x"}', "Easy"),
        (3, "not json", "Easy"),
        (4, json.dumps({"problems": [item(title="t" * 201), item(title="t" * 200, description="")]}), "hard"),
        (5, json.dumps({"problems": [item(title=" "), item(correct_sql=None), item(topics=None)]}), "HARD"),
        (6, json.dumps({"problems": [item(topics=["y" * 120, " a ", "", "a", None])]}), None),
        (7, json.dumps({"problems": [item()]}), "xyz"),
        (8, None, "Easy"),
    ]
    problems, topics, refused = generated(spark, payloads)
    assert [r[0] for r in refused] == [1, 2, 3, 8]
    assert [(r[0], r[1], len(r[2]), r[2][-3:], r[3], r[5]) for r in problems] == [
        (4, 0, 200, "...", "d", "Hard"), (4, 1, 200, "ttt", None, "Hard"), (5, 2, 1, "T", "d", "Hard"),
        (6, 0, 1, "T", "d", "Easy"), (7, 0, 1, "T", "d", "Easy"),
    ]
    assert all(r[4] == "SELECT 1" for r in problems)
    assert [r for r in topics if r[0] == 6] == [(6, 0, "a"), (6, 0, "y" * 100)]


def test_parse_answer(spark):
    frame = spark.createDataFrame(
        [('{"sql": " SELECT 1 ", "explanation": "one"}',), ("{}",), ("oops",)], "answer string"
    )
    found = rows(quality.parse_answer(frame, "answer").select("sql", "explanation"))
    assert found == [("SELECT 1", "one"), ("", ""), ("", "")]


def test_feedback_and_score_rules(spark):
    reviews = spark.createDataFrame(
        [(1, 9, None), (2, 9, ""), (3, None, None)], "id long, mentor_id long, feedback string"
    )
    valid, rejected = quality.feedback_rule(reviews)
    assert sorted(r[0] for r in rows(valid)) == [2, 3]
    assert [(r[0], r[-1]) for r in rows(rejected)] == [(1, "feedback required")]
    scores = [None, "0", "100", "100.01", "-1"]
    frame = spark.createDataFrame([(s and Decimal(s),) for s in scores], "score decimal(6,2)")
    valid, rejected = quality.score_range_rule(frame)
    assert valid.count() == 3 and sorted(float(r[0]) for r in rows(rejected)) == [-1.0, 100.01]


def test_keys_vocabulary_orphans(spark, seed):
    assert rows(quality.all_keys(seed)) == []
    assert rows(quality.orphan_check(seed)) == []
    twice = seed.replace(user=seed.user.union(seed.user.filter("user_id = 3")))
    found = {(r[1], r[2], r[3]) for r in rows(quality.all_keys(twice))}
    assert found == {("user_id", "3", 2), ("email", "p3@example.com", 2)}
    lost = seed.replace(problem=seed.problem.filter("problem_id <> 104"), mentor=seed.mentor.filter("user_id <> 24"))
    assert sorted(rows(quality.orphan_check(lost))) == [
        ("attempt", "problem_id", "problem", "104", 2), ("have_topic", "problem_id", "problem", "104", 2),
    ]
    odd = seed.user.withColumn("status", F.when(F.col("user_id") < 3, "gone").otherwise(F.col("status")))
    assert rows(quality.vocabulary_rule(odd, "user")) == [("user", "status", "gone", 2)]


def test_orphans_of_any_key(spark, seed):
    """Negative and far keys, keys of one block, blanks, repeats and nulls; against a set difference."""
    keys = [*range(-130, 130), 63, 64, 2**40, 2**62, -(2**62), 2**63 - 1, -(2**63), 101, 101, None]
    held = [k for k in keys if k is not None and k % 3 == 0]
    text = [None, "", "joins", "Joins", "joins ", "naïve", "joins"]
    pairs = [(k, text[i % len(text)]) for i, k in enumerate(keys)]
    problem = spark.createDataFrame([(k,) for k in {*held}], "problem_id long")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in seed.problem.schema if f.name != "problem_id"]
    t = seed.replace(
        problem=problem.select("problem_id", *blank),
        have_topic=spark.createDataFrame(pairs, seed.have_topic.schema).repartition(3),
        attempt=seed.attempt.limit(0),
    )
    lost = Counter(("problem_id", "problem", str(k)) for k, _ in pairs if k is not None and k not in held)
    lost += Counter(("topic_name", "topic", w) for _, w in pairs if w is not None and w != "joins")
    found = rows(quality.orphan_check(t))
    assert sorted(found) == sorted(("have_topic", *key, n) for key, n in lost.items())


def test_near_references_travel_together(spark, seed):
    """64 keys in a row are one row, whatever the number of rows that hold them."""
    ids = spark.range(0, 6_400, 1, 4).select(F.col("id").alias("resource_id"), (F.col("id") % 128).alias("student_id"), F.lit(None).cast("timestamp_ntz").alias("access_time"))
    blocks = quality.reference_blocks(seed.replace(access=ids), "access")
    assert blocks.groupBy("edge").count().count() == 2 and blocks.count() == 100 + 2


def test_required_and_length(spark):
    users = [(1, "n", "e", "p", "active"), (2, None, " ", "p", "much too long status"), (3, "x" * 101, "e3", "", None)]
    frame = spark.createDataFrame(users, "user_id long, name string, email string, password string, status string")
    assert sorted(rows(quality.required_and_length(frame, "user"))) == [
        (2, "email", "blank"), (2, "name", "missing"), (2, "status", "too long"), (3, "name", "too long"),
        (3, "password", "blank"),
    ]


def test_delta_keys(spark, seed):
    again = seed.user.filter("user_id in (2, 3)").withColumn("user_id", F.when(F.col("user_id") == 2, 90).otherwise(F.col("user_id")))
    fresh = seed.user.filter("user_id = 1").withColumns({"user_id": F.lit(91).cast("long"), "email": F.lit(None).cast("string")})
    attempts = seed.attempt.filter("student_id = 1").withColumn("attempt_no", F.col("attempt_no") + 1)
    twice = attempts.union(attempts.filter("problem_id = 102"))
    found = rows(quality.delta_keys(seed, {"user": again.union(fresh).union(fresh), "attempt": twice}))
    assert sorted(found) == [
        ("attempt", "student_id,problem_id,attempt_no", "1,101,2", 1, 1),
        ("attempt", "student_id,problem_id,attempt_no", "1,102,2", 2, 0),
        ("user", "email", "null", 2, 0),
        ("user", "email", "p2@example.com", 1, 1),
        ("user", "email", "p3@example.com", 1, 1),
        ("user", "user_id", "3", 1, 1),
        ("user", "user_id", "91", 2, 0),
    ]
    assert rows(quality.delta_keys(seed, {"user": seed.user.limit(0)})) == []
    nameless = seed.replace(user=seed.user.union(fresh))
    assert ("user", "email", "null", 1, 1) in rows(quality.delta_keys(nameless, {"user": fresh}))


def test_delta_orphans(spark, seed):
    topic = seed.topic.filter("topic_name = 'sets'").withColumn("topic_name", F.lit("new"))
    bridge = spark.createDataFrame([(101, "new"), (101, "lost"), (999, "joins"), (998, "lost"), (None, None)], seed.have_topic.schema)
    found = rows(quality.delta_orphans(seed, {"topic": topic, "have_topic": bridge}))
    assert sorted(found) == [
        ("have_topic", "problem_id", "problem", "998", 1), ("have_topic", "problem_id", "problem", "999", 1),
        ("have_topic", "topic_name", "topic", "lost", 2),
    ]
    assert rows(quality.delta_orphans(seed, {"have_topic": bridge.limit(0)})) == []


def test_a_delta_meets_only_keys_of_its_range(spark, bound):
    """Bounds of the delta's keys are in the scan, and the snapshot is not shuffled."""
    path = shared_folder(spark, "delta")
    tables.write_snapshot(bound, path, changed=["attempt"])
    held = tables.load(spark, path)
    delta = held.attempt.orderBy("student_id").limit(20)
    found = quality.delta_keys(held, {"attempt": delta})
    assert found.count() > 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "/attempt/" in line)
    assert "GreaterThanOrEqual(student_id" in scan and "LessThanOrEqual(student_id" in scan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
