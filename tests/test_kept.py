"""Counts that follow the write jobs, against the views built anew."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from classmeter.functions import numbering
from classmeter.operators import kept, reports, writes
from classmeter.session import deal, shared_folder, written
from classmeter.sources import tables
from conftest import rows

NEW = "student_id long, problem_id long, score decimal(5,2), submit_time timestamp_ntz"
REVIEW = "student_id long, problem_id long, attempt_no int, mentor_id long, feedback string, sent_at timestamp_ntz"
T0 = datetime.datetime(2024, 5, 1, 8, 0)


def views(t, counts=None):
    made = [
        (reports.student_performance(t), reports.problem_statistics(t), reports.mentor_activity(t))
        if counts is None
        else (kept.student_performance(t, counts), kept.problem_statistics(t, counts), kept.mentor_activity(t, counts))
    ]
    return [sorted(rows(frame), key=str) for frame in made[0]]


def append(spark, t, rng):
    made = [
        (rng.randint(1, 6), rng.choice([101, 103, 105, 107]), rng.choice([None, Decimal(rng.randint(0, 100))]), T0)
        for _ in range(rng.randint(0, 4))
    ]
    new = written(writes.number_attempts(t, spark.createDataFrame(made, NEW)), "new")
    return t.replace(attempt=t.attempt.unionByName(new)), kept.added(attempt=new)


def review(spark, t, rng):
    author = {r.problem_id: r.user_id for r in t.problem.collect()}
    made = [(*r[:3], author.get(r[1]), rng.choice([" ", "seen"]), T0) for r in rows(t.attempt) if rng.random() < 0.4]
    accepted = written(writes.accepted_feedback(t, spark.createDataFrame(made, REVIEW)), "accepted")
    return writes.with_feedback(t, accepted), kept.feedback_changes(t, accepted)


def drop_problems(spark, t, rng):
    asked = t.problem.select(F.col("user_id").alias("mentor_id"), "problem_id").filter(F.col("problem_id") % 2 == rng.randint(0, 1))
    gone = written(writes.problem_delete_outcomes(t, asked).filter("outcome = 'deleted'").select("problem_id"), "gone")
    return writes.without_problems(t, gone), kept.problem_changes(t, gone)


def drop_users(spark, t, rng):
    asked = spark.createDataFrame([(u,) for u in rng.sample([*range(1, 7), *range(21, 25)], 2)], "user_id long")
    removal = writes.plan_removal(t, asked, guard=rng.random() < 0.4)
    return writes.without_removed(t, removal), kept.removal_changes(t, removal)


def fixed(t):
    """The next snapshot, written, so that plans stay short."""
    return t.replace(**{name: written(t[name], name) for name in ("user", "student", "mentor", "problem", "attempt", "resource", "have_topic", "scenario")})


@pytest.mark.parametrize("seed_number, steps", [(1, [append, review, drop_users]), (2, [drop_problems, drop_users, append, drop_users])])
def test_any_chain_of_writes(spark, seed, seed_number, steps):
    rng, t, counts = random.Random(seed_number), seed, kept.build(seed)
    assert views(t, counts) == views(t)
    for step in steps:
        t, changes = step(spark, t, rng)
        counts = kept.settled(kept.fold(counts, changes))
        t = fixed(t)
        assert views(t, counts) == views(t), step.__name__


def test_changes_in_any_order(spark, seed):
    """The last attempt of a pair and a best score go before other rows come, and a removal before its rows."""
    of = lambda rule: seed.attempt.filter(rule)
    changes = [kept.removed(attempt=of("score >= 95")), kept.added(attempt=of("student_id = 1")), kept.removed(attempt=of("student_id = 1"))]
    t = seed.replace(attempt=of("score < 95"))
    for order in ([0, 1, 2], [2, 1, 0]):
        counts = kept.build(seed)
        for i in order:
            counts = kept.settled(kept.fold(counts, changes[i]))
        assert views(t, counts) == views(t)
    assert views(t, kept.fold(kept.build(seed), kept.together(*changes))) == views(t)


def test_an_empty_platform(spark, seed):
    empty = seed.replace(**{name: seed[name].limit(0) for name in ("attempt", "problem", "resource")})
    counts = kept.build(empty)
    assert all(frame.count() == 0 for frame in counts.frames.values()) and views(empty, counts) == views(empty)
    filled = kept.fold(counts, kept.added(attempt=seed.attempt, problem=seed.problem, resource=seed.resource))
    assert views(seed, filled) == views(seed)


def test_counts_belong_to_a_version(spark, seed):
    path = shared_folder(spark, "platform")
    version = tables.write_snapshot(seed, path)
    assert kept.load(spark, path, version) is None
    kept.write(kept.build(seed), path, version)
    t = tables.load(spark, path)
    assert views(t, kept.load(spark, path, version)) == views(seed)


def dealt(t):
    return t.replace(attempt=deal(t.attempt, "attempts", "student_id", writes.ATTEMPT).rows())


def test_many_changes_become_runs(spark, seed, monkeypatch):
    """Counts are not written anew for many changes, and the runs are read without a shuffle."""
    monkeypatch.setattr(kept, "FEW", 0)
    rng, t = random.Random(5), dealt(seed)
    base = counts = kept.build(t)
    for step in (append, drop_users):
        t, changes = step(spark, t, rng)
        counts, before = kept.settled(kept.fold(counts, changes)), counts
        t = dealt(t)
        assert views(t, counts) == views(t), step.__name__
        held = before.runs["tries"].runs
        assert counts.runs["tries"].runs[: len(held)] == held
    assert len(counts.runs["tries"].runs) > 1 and views(seed, base) == views(seed)  # who holds the first run sees no later one
    per_student = counts["tries"].filter("n > 0").groupBy("student_id").count()
    assert "Exchange" not in per_student._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(kept, "MOST_RUNS", 1)
    one = kept.settled(counts)
    assert len(one.runs["tries"].runs) == 1 and views(t, one) == views(t)


def test_the_platform_s_rows_are_shuffled_by_student_once(spark, bound, monkeypatch):
    """Each version of the attempts and all their counts lie by student; only new attempts and reviews move there."""
    from pyspark.sql import DataFrameWriter

    from classmeter.plans import catalog

    plans, save = [], DataFrameWriter.saveAsTable

    def spy(self, name, *args, **options):
        plans.append((name.split("dealt_")[1].rsplit("_", 1)[0], self._df._jdf.queryExecution().executedPlan().toString()))
        return save(self, name, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", spy)
    monkeypatch.setattr(kept, "FEW", 0)
    catalog.followed(bound)
    moved = {name: plan.count("REPARTITION_BY_NUM") for name, plan in plans}
    assert {"attempts", "kept_tries", "kept_marks", "kept_reviews", "numbered"} <= set(moved)
    for name, plan in plans:
        if name.startswith("kept_") and "dealt_" in plan:
            assert "Exchange" not in plan, name
    assert moved["attempts"] == 1 and moved["reviewed_attempts"] <= 1


def test_dealt_attempts_are_numbered_and_reviewed_alike(spark, seed, monkeypatch):
    made = [(s, p, Decimal(n), T0 + datetime.timedelta(hours=n % 2), f"select {n % 3}") for n, (s, p) in enumerate([(1, 101), (2, 103), (None, 101), (1, None)] * 4)]
    scored = spark.createDataFrame(made, f"{NEW}, student_sql string")
    plain = sorted(rows(writes.number_attempts(seed, scored)), key=str)
    for crowd in (numbering.CROWD, 3):
        monkeypatch.setattr(numbering, "CROWD", crowd)
        assert sorted(rows(writes.number_attempts(dealt(seed), scored, dealt=True)), key=str) == plain
    author = {r.problem_id: r.user_id for r in seed.problem.collect()}
    given = [(*r[:3], author[r[1]], text, T0) for r in rows(seed.attempt) for text in ("seen", "again", None)]
    given += [(None, 101, 1, author[101], "nobody", T0), (1, 101, 1, author[101], "late", None)]
    updates = spark.createDataFrame(given, REVIEW)
    found = [sorted(rows(writes.accepted_feedback(seed, updates, dealt=d)), key=str) for d in (False, True)]
    assert found[0] == found[1] and {r[4] for r in found[0]} == {"seen", "nobody"}


def test_what_a_removal_meets_is_found_with_few_and_many_keys(spark, seed, monkeypatch):
    twice, nobody, other = seed.attempt.limit(3), seed.attempt.limit(2).withColumn("student_id", F.lit(None).cast("long")), seed.attempt.withColumn("mentor_id", F.lit(21).cast("long"))
    t = seed.replace(attempt=seed.attempt.unionByName(twice).unionByName(nobody).unionByName(other))
    asked = spark.createDataFrame([(1,), (2,), (21,)], "user_id long")
    found = []
    for few in (writes.FEW_GONE, 0):
        monkeypatch.setattr(writes, "FEW_GONE", few)
        removal = writes.plan_removal(t, asked, guard=False)
        met = writes.hit(removal, "attempt", t.attempt)
        told = writes.told(removal, "attempt", t.attempt).filter("_lost is not null")
        assert sorted(rows(met.select(*told.columns)), key=str) == sorted(rows(told), key=str)
        found.append(sorted(rows(met), key=str))
    assert found[0] == found[1] and {r._lost for r in met.collect()} == {True, False}
