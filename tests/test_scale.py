"""What keeps the large jobs from doing a step more than once."""

import datetime as dt

from pyspark.sql import functions as F

from classmeter.functions import numbering, sqltext
from classmeter.operators import kept, mentor, scoring, writes
from classmeter.streaming import streams
from conftest import rows


def test_a_text_is_normalised_once(spark):
    texts = spark.createDataFrame([("select a from t where (x = 1) and  y=2 -- c",), ("update t",), (None,)], "sql string")
    parts = texts.select(sqltext.split_clauses(F.col("sql")).alias("c"))
    found = parts.select(sqltext.extract_conditions(F.col("c.where")).alias("found"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 1
    assert rows(found) == [(["x = 1", "y=2"],), ([],), ([],)]


def test_crowded_keys_are_numbered_alike(spark, monkeypatch):
    day = dt.datetime(2024, 1, 1)
    data = [(n % 3 if n > 9 else 7, day + dt.timedelta(days=n % 5), n) for n in range(40)] + [(None, None, 50)]
    frame = spark.createDataFrame(data, "k long, at timestamp_ntz, n long")
    numbered = lambda: sorted(rows(numbering.number_within(frame, ["k"], [F.asc_nulls_last("at"), F.asc("n")], "i")), key=str)
    plain = numbered()
    monkeypatch.setattr(numbering, "CROWD", 9)
    assert numbered() == plain
    for key in (0, 1, 2, 7):
        assert sorted(r[3] for r in plain if r[0] == key) == list(range(1, 1 + sum(r[0] == key for r in data)))


def test_a_batch_is_numbered_without_ranges(seed, spark):
    day = dt.datetime(2024, 5, 1)
    scored = spark.createDataFrame([(11, 31, "x", 5.0, day)], "student_id long, problem_id long, student_sql string, score double, submit_time timestamp_ntz")
    plan = writes.number_attempts(seed, scored)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "LeftSemi" not in plan


def test_reviews_move_their_own_counts_only(seed, spark):
    accepted = seed.attempt.select(*writes.ATTEMPT, F.lit(5).cast("long").alias("_mentor"), F.lit("x").alias("_feedback"))
    assert set(kept.feedback_changes(seed, accepted)) == {"reviews"}


def test_plain_texts_are_split_without_lambdas(spark):
    """A guarded pattern and a plain text's parts are built-in expressions; odd texts give what they gave."""
    texts = [
        ("a, b ,a", ["a", "b"]), ("t.x as y, `b`", ["b", "x"]), (" a,  ,b.", ["", "a"]), ("f(a, b), c", ["b)", "c", "f(a"]), ("", []),
    ]
    frame = spark.createDataFrame([(t,) for t, _ in texts], "listed string")
    assert sorted(rows(frame.select("listed", sqltext.extract_columns(F.col("listed"))))) == sorted(texts)
    odd = [("SELECT a; ", "select a"), ("select a -- c;\n from t", "select a from t"), ("a;--x", "a;"), ("a;;", "a;"), ("a\x1cb", "a b")]
    frame = spark.createDataFrame([(t,) for t, _ in odd], "sql string")
    assert sorted(rows(frame.select("sql", sqltext.normalize_sql_text(F.col("sql"))))) == sorted(odd)
    parts = frame.select(sqltext.extract_conditions(F.col("sql")).alias("c"))
    assert "CASE WHEN" in parts._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_taken_apart_after_the_join(seed, spark):
    """The shuffle carries submitted texts, not their parts."""
    given = spark.createDataFrame([(11, 31, "select a from t")], "student_id long, problem_id long, student_sql string")
    plan = scoring.score_submissions(given, seed.problem)._jdf.queryExecution().optimizedPlan().toString()
    assert "student_raw" in plan.split("Join Inner")[0] and "student_raw" not in plan.split("Join Inner", 1)[1]


def test_few_and_many_keys_get_the_same_numbers(spark, tmp_path, monkeypatch):
    """State of many keys is read without a join of its own, and a run is not shuffled by its buckets."""
    from classmeter.streaming import batches

    state = lambda name: streams._numbers(batches.Batches(spark, str(tmp_path / name)))
    held = spark.createDataFrame([(s, p, s + p) for s in range(9) for p in range(5)], streams.LAST_NUMBER)
    run = state("few").write_run(held.union(held), -1, "base")
    keys = held.select("student_id", "problem_id").filter("student_id < 4").union(held.select("student_id", "problem_id").limit(2))
    few = state("few").read([run], keys)
    assert "LeftSemi" in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(batches, "FEW", 3)
    many = state("few").read([run], keys)
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString()
    wanted = keys.distinct()
    assert sorted(rows(few)) == sorted(rows(many.join(wanted, ["student_id", "problem_id"], "left_semi")))
    assert sorted(rows(few)) == sorted((s, p, s + p) for s in range(4) for p in range(5))


def test_titles_join_last(seed):
    """No shuffle of a listing of reviews carries a title; reviewers join first."""
    plan = mentor.review_attempts(seed)._jdf.queryExecution().optimizedPlan().toString()
    places = [plan.index(join) for join in ("Join Inner, (problem_id", "Join Inner, (student_id", "Join LeftOuter, ((mentor_id")]
    assert places == sorted(places)
    one = rows(mentor.review_attempts(seed, 21))
    assert sorted(map(str, one)) == sorted(str(r) for r in rows(mentor.review_attempts(seed)) if r[0] == 21) and one


def test_a_cascade_s_attempts_are_built_once(spark, bound):
    from classmeter.plans import catalog

    settled = catalog.settled_attempts(bound)
    assert "lineitem" not in settled.attempt._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, rows(settled.attempt))) == sorted(map(str, rows(bound.attempt)))
