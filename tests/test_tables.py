"""Snapshots, defaults, ids, text form, numbering."""

import datetime
import zoneinfo
import random

import pytest
from pyspark.sql import functions as F

from classmeter.functions import exprs, filters
from classmeter.functions.numbering import number_within
from classmeter.operators import admin, learner
from classmeter.session import shared_folder
from classmeter.sources import tables
from classmeter.sources.schemas import SCHEMAS
from conftest import rows


def test_snapshot_round_trip(spark, seed):
    path = shared_folder(spark, "test")
    tables.write_snapshot(seed, path)
    tables.write_snapshot(seed, path)
    back = tables.load(spark, path)
    for name, schema in SCHEMAS.items():
        assert back[name].schema == schema
        assert sorted(map(str, rows(back[name]))) == sorted(map(str, rows(tables.typed(seed[name], name))))
    names = tables.register(spark, back)
    assert len(names) == 18
    assert tables.CommitLog(spark, f"{path}/_versions").numbers() == [1, 2]
    assert spark.sql("SELECT max(total_attempts) FROM studentperformancesummary").collect()[0][0] == 4


def test_shared_folder_is_the_session_s(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_defaults(spark):
    now = F.lit(datetime.datetime(2024, 1, 2, 3, 4)).cast("timestamp_ntz")
    given = spark.createDataFrame([(1, None), (2, "Super")], "user_id long, admin_level string")
    assert rows(tables.with_defaults(given, "admin")) == [(1, "Standard"), (2, "Super")]
    student = tables.with_defaults(given.select("user_id"), "student", now)
    assert rows(student)[0] == (1, datetime.date(2024, 1, 2), 0)
    mentor = tables.with_defaults(given.select("user_id"), "mentor")
    assert rows(mentor)[0] == (1, "General", 0)


def test_ids_do_not_depend_on_partitions(spark):
    new = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    existing = spark.createDataFrame([(41,)], "id long")
    once = tables.assign_ids(new.repartition(13), existing, "id", ["k"])
    again = tables.assign_ids(new.repartition(3), existing, "id", ["k"])
    assert sorted(rows(once)) == sorted(rows(again)) == [(k, k + 42) for k in range(5000)]
    empty = existing.limit(0)
    assert min(r.id for r in tables.assign_ids(new, empty, "id", ["k"]).collect()) == 1


def test_numbering_with_a_hot_key(spark):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    data = []
    for i in range(6000):
        key = 1 if rng.random() < 0.4 else rng.randrange(2, 900)
        time = None if rng.random() < 0.02 else start + datetime.timedelta(hours=rng.randrange(2000))
        data.append((i, key, time))
    frame = spark.createDataFrame(data, "i long, k long, at timestamp_ntz").repartition(7)
    for newest in (False, True):
        order = [F.desc_nulls_first("at") if newest else F.asc_nulls_last("at"), F.asc("i")]
        found = number_within(frame, ["k"], order, "n")
        late = datetime.datetime.max
        sign = lambda t: -(t or late).timestamp() if newest else (t or late).timestamp()
        expected, seen = {}, {}
        for i, key, time in sorted(data, key=lambda d: (d[1], sign(d[2]), d[0])):
            seen[key] = seen.get(key, 0) + 1
            expected[i] = seen[key]
        assert {r.i: r.n for r in found.collect()} == expected


@pytest.mark.parametrize("kind", ["hashed", "one day", "nulls", "ties"])
def test_numbering_blocks_are_even(spark, kind):
    """Sparse ids, a single day, null times and ties: the right numbers, from blocks of about one size."""
    day = datetime.datetime(2024, 1, 1)
    i = F.col("id")
    value = {
        "hashed": F.xxhash64("id"),
        "one day": F.timestamp_seconds(F.lit(day.timestamp()) + i % 86_000),
        "nulls": F.when(i % 3 > 0, F.timestamp_seconds(i)),
        "ties": F.lit(5),
    }[kind]
    frame = spark.range(8_000).select(F.when(i % 2 == 0, 1).otherwise(i).alias("k"), value.alias("at"), "id")
    found = number_within(frame.repartition(5), ["k"], [F.asc_nulls_last("at"), F.asc("id")], "n")
    rows_ = found.select("k", "at", "id", "n").collect()
    last = lambda r: (r.k, r.at is None, r.at if r.at is not None else 0, r.id)
    seen = {}
    for r in sorted(rows_, key=last):
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.n == seen[r.k]
    everything = number_within(frame, [], [F.asc_nulls_last("at"), F.asc("id")], "n")
    assert sorted(r.n for r in everything.collect()) == list(range(1, 8_001))
    written_ = [p for p in everything.inputFiles()]
    blocks = spark.read.parquet(*written_).groupBy("_block").count().collect()
    assert len(blocks) == 8 and max(b["count"] for b in blocks) < 2 * 8_000 / 8


def test_recommendations_against_brute_force(spark, bound):
    tried = {}
    for student, problem in rows(bound.attempt.select("student_id", "problem_id")):
        tried.setdefault(student, set()).add(problem)
    listed = [r[0] for r in sorted(
        rows(bound.problem.filter("difficulty <> 'Hard'").select("problem_id", "difficulty")), key=lambda r: (r[1], r[0])
    )]
    expected = []
    for (student,) in rows(bound.student.select("user_id")):
        open_ones = [p for p in listed if p not in tried.get(student, ())]
        expected += [(student, j, p) for j, p in enumerate(open_ones[:5], 1)]
    found = learner.recommend_problems(bound).select("student_id", "choice", "problem_id")
    assert sorted(rows(found)) == sorted(expected)


def test_recommendations_run_out(spark, seed):
    every = seed.student.select(F.col("user_id").alias("student_id")).filter("student_id < 3").join(
        seed.problem.select("problem_id").filter("problem_id <> 106"), F.lit(True)
    )
    t = seed.replace(attempt=every)
    found = sorted(rows(learner.recommend_problems(t).select("student_id", "choice", "problem_id")))
    assert [r[::2] for r in found if r[0] < 3] == [(1, 106), (2, 106)]
    assert [r[2] for r in found if r[0] == 3] == [101, 103, 106, 102, 105]


def test_text_form(spark):
    values = [0.1, 1e16, 1.5e300, 1e-5, 123456789.25, 1e7, 12345678901234.5, 0.0001, -2.5e-7, 0.0, 100.0,
              float("inf"), float("nan"), None, 1e22, 3.0e-10]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.v for r in tables.as_text(frame).collect()] == [str(v) for v in values]
    times = [datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2, 3, 4, 5, 120000), None]
    frame = spark.createDataFrame([(t, True, 7) for t in times], "t timestamp_ntz, b boolean, n int")
    assert rows(tables.as_text(frame)) == [(str(t), "True", "7") for t in times]


@pytest.mark.parametrize("stopped_at", ["user", "attempt", "receive"])
def test_a_refresh_that_stops_is_read_as_the_old_version(spark, seed, stopped_at):
    path = shared_folder(spark, "stopped")
    tables.write_snapshot(seed, path)

    def lost():
        raise RuntimeError("lost")

    emptied = {name: seed[name].limit(0) for name in SCHEMAS}
    broken = tables.Tables({**{n: (lambda n=n: emptied[n]) for n in SCHEMAS}, stopped_at: lost})
    with pytest.raises(RuntimeError):
        tables.write_snapshot(broken, path)
    back = tables.load(spark, path)
    for name in SCHEMAS:
        assert back[name].count() == seed[name].count()


def test_versions(spark, seed):
    path = shared_folder(spark, "versions")
    assert tables.write_snapshot(seed, path) == 1
    assert tables.write_snapshot(seed.replace(topic=seed.topic.limit(1)), path, changed=["topic"]) == 2
    assert tables.write_snapshot(seed.replace(topic=seed.topic.limit(2)), path, changed=["topic"]) == 3
    assert [tables.load(spark, path, v).topic.count() for v in (1, 2, 3)] == [seed.topic.count(), 1, 2]
    tables.drop_versions(spark, path, keep=1)
    back = tables.load(spark, path)
    assert back.topic.count() == 2 and back.attempt.count() == seed.attempt.count()
    with pytest.raises(Exception):
        tables.load(spark, path, 1)
    with pytest.raises(FileExistsError):
        tables.CommitLog(spark, f"{path}/_versions").write(3, {})


def test_folders_without_versions_are_read(spark, seed):
    path = shared_folder(spark, "plain")
    tables.typed(seed.topic, "topic").write.parquet(f"{path}/topic")
    assert tables.load(spark, path).topic.count() == seed.topic.count()


# Days of change: an ordinary one, one at midnight in both ways, half an hour, and a day left out.
@pytest.mark.parametrize(
    "zone, day",
    [
        ("America/Los_Angeles", "2024-03-10"),
        ("America/Los_Angeles", "2024-11-03"),
        ("America/Sao_Paulo", "2018-02-18"),
        ("America/Sao_Paulo", "2018-11-04"),
        ("Australia/Lord_Howe", "2024-04-07"),
        ("Pacific/Apia", "2011-12-30"),
        ("UTC", "2024-01-01"),
    ],
)
def test_local_dates_around_changes(spark, zone, day):
    start = datetime.datetime.fromisoformat(day) - datetime.timedelta(days=3)
    times = [start + datetime.timedelta(minutes=20 * i, seconds=s) for i in range(72 * 6) for s in (0, 1199)]
    table = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    dates = [t.replace(tzinfo=datetime.timezone.utc).astimezone(zoneinfo.ZoneInfo(zone)).date().isoformat() for t in times]
    days = sorted({(datetime.date.fromisoformat(day) + datetime.timedelta(days=d)).isoformat() for d in range(-1, 2)})
    for first, last in [(d, None) for d in days] + [(None, d) for d in days] + [(d, d) for d in days]:
        want = [t for t, d in zip(times, dates) if (first is None or d >= first) and (last is None or d <= last)]
        got = filters.dates_between(table, F.col("t"), first, last, zone)
        assert sorted(r.t for r in got.collect()) == want


def test_local_dates_reach_the_scan(spark, seed):
    path = shared_folder(spark, "pushed")
    seed.attempt.write.parquet(path)
    found = filters.dates_between(spark.read.parquet(path), F.col("submit_time"), "2024-03-02", "2024-03-05", "America/Los_Angeles")
    setting = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "5000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(setting, before)
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(submit_time,2024-03-02T08:00" in pushed and "LessThan(submit_time,2024-03-06T08:00" in pushed


def test_filters(spark, seed):
    names = spark.createDataFrame([("50% off_x",), ("50 percent",)], "n string")
    assert names.filter(filters.contains_text(F.col("n"), "0% OFF_")).count() == 1
    times = spark.createDataFrame(
        [(datetime.datetime(2024, 3, 2, 7, 59),), (datetime.datetime(2024, 3, 2, 8, 0),)], "t timestamp_ntz"
    )
    local = filters.dates_between(times, F.col("t"), "2024-03-02", None, "America/Los_Angeles")
    assert local.count() == 1
    assert filters.dates_between(times, F.col("t"), "2024-03-02", "2024-03-02").count() == 2
    assert filters.feedback_is(seed.attempt, "yes").count() == 6
    assert filters.feedback_is(seed.attempt, "no").count() == 7
    with pytest.raises(ValueError):
        admin.audience(seed, "specific")


def test_display(spark):
    row = spark.createDataFrame(
        [(datetime.datetime(2024, 3, 5, 16, 7), "one two  three")], "t timestamp_ntz, s string"
    ).select(
        exprs.display_date(F.col("t")).alias("a"),
        exprs.display_date(F.col("t"), "MMMM", True).alias("b"),
        exprs.first_words(F.col("s"), 2).alias("c"),
        exprs.first_words(F.col("s"), 3).alias("d"),
        exprs.pass_rate_tier(F.lit(50)).alias("e"),
        exprs.half_up(F.lit("2.25").cast("decimal(5,2)"), 1).alias("f"),
    ).first()
    assert tuple(row) == ("Mar. 05, 2024", "March 05, 2024, 4:07 p.m.", "one two …", "one two three", "warning", 2.3)
