"""Streams give what the batch forms give, also over several files and a restart."""

import pytest
from pyspark.sql import functions as F

from classmeter.operators import quality, writes
from classmeter.session import shared_folder
from classmeter.sources.schemas import SCHEMAS
from classmeter.streaming import streams
from classmeter.streaming.batches import Batches
from conftest import rows


@pytest.fixture(scope="module")
def inserted(spark, seed):
    """Attempt files in time order, one per micro-batch."""
    path = shared_folder(spark, "files")
    ordered = seed.attempt.orderBy("submit_time").collect()
    for i in range(0, 13, 5):
        spark.createDataFrame(ordered[i : i + 5], SCHEMAS["attempt"]).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, relation="attempt"):
    reader = spark.readStream.schema(SCHEMAS[relation]).option("maxFilesPerTrigger", 1)
    return reader.parquet(path)


def test_alerts(spark, seed, inserted):
    out = shared_folder(spark, "alerts")
    known = seed.notification
    for _ in range(2):
        query = streams.high_score_stream(stream(spark, inserted), known, f"{out}/o", f"{out}/c")
        query.awaitTermination()
    sent, got = streams.read_alerts(spark, f"{out}/o")
    batch = writes.alert_rows(seed.attempt, known)
    assert sorted(r[0] for r in rows(got)) == sorted(r.student_id for r in batch.collect())
    assert sorted(r[0] for r in rows(sent)) == list(range(11, 16))


def test_counts(spark, seed):
    path, out = shared_folder(spark, "problems"), shared_folder(spark, "counts")
    for low, high in ((101, 103), (104, 107)):
        part = seed.problem.filter(F.col("problem_id").between(low, high))
        part.coalesce(1).write.mode("append").parquet(path)
        problems = stream(spark, path, "problem")
        streams.problem_count_stream(problems, f"{out}/o", f"{out}/c").awaitTermination()
    found = rows(streams.read_problem_counts(spark, f"{out}/o"))
    assert sorted(found) == sorted(rows(writes.running_problem_counts(seed.problem))) == [(21, 3), (22, 3), (23, 1)]


def test_gate(spark, seed, inserted):
    out = shared_folder(spark, "gate")
    broken = stream(spark, inserted).withColumn(
        "feedback", F.when(F.col("student_id") != 4, F.col("feedback"))
    ).withColumn("score", F.when(F.col("student_id") == 5, F.col("score") + 10).otherwise(F.col("score")))
    streams.stream_quality_gate(broken, f"{out}/o", f"{out}/c").awaitTermination()
    counts = dict(rows(streams.read_gate(spark, f"{out}/o").groupBy("outcome").count()))
    assert counts == {"feedback required": 2, "score out of range": 1, "valid": 10}
    assert quality.feedback_rule(seed.attempt)[1].count() == 0


def numbered(spark, path, out, last=None):
    streams.numbering_stream(stream(spark, path), f"{out}/o", f"{out}/c", last).awaitTermination()
    return streams.read_numbered(spark, f"{out}/o")


def test_numbering(spark, seed, inserted):
    out = shared_folder(spark, "numbers")
    for _ in range(2):  # the second start finds nothing new
        found = rows(numbered(spark, inserted, out).select("student_id", "problem_id", "attempt_no", "score"))
        expected = rows(seed.attempt.select("student_id", "problem_id", "attempt_no", "score"))
        assert sorted(found) == sorted(expected)


def test_numbering_goes_on(spark, seed, inserted):
    out = shared_folder(spark, "numbers")
    found = rows(numbered(spark, inserted, out, seed.attempt).select("student_id", "problem_id", "attempt_no"))
    assert sorted(r[2] for r in found if r[:2] == (1, 101)) == [3, 4]
    assert sorted(r[2] for r in found if r[:2] == (1, 103)) == [2]


def test_numbering_a_large_pair_in_reversed_order(spark):
    """One pair has most rows of a batch, newest first in the file; a second batch goes on."""
    path, out = shared_folder(spark, "files"), shared_folder(spark, "numbers")
    time = F.timestamp_seconds(10**9 - F.col("id")).cast("timestamp_ntz")
    rows_ = spark.range(25_000).select(
        F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(1).alias("student_id"), F.lit(5).cast("long").alias("problem_id"),
        F.lit(None).cast("int").alias("attempt_no"), F.lit(None).cast("long").alias("mentor_id"),
        (F.col("id") % 100).cast("decimal(5,2)").alias("score"), time.alias("submit_time"), F.lit(None).cast("string").alias("feedback"),
    )
    for part in ("id >= 12000", "id < 12000"):
        kept = rows_.withColumn("id", 10**9 - F.unix_seconds(F.col("submit_time").cast("timestamp"))).filter(part).drop("id")
        kept.coalesce(1).write.mode("append").parquet(path)
        found = numbered(spark, path, out)
    mine = found.filter("student_id = 1").orderBy("submit_time").collect()
    assert [r.attempt_no for r in mine] == list(range(1, len(mine) + 1)) and len(mine) > 24_000


def test_streams_without_output_read_as_empty(spark, seed):
    empty = shared_folder(spark, "empty")
    seed.attempt.limit(0).write.parquet(empty)
    out = shared_folder(spark, "none")
    assert numbered(spark, empty, f"{out}/n").count() == 0
    streams.high_score_stream(stream(spark, empty), seed.notification, f"{out}/a", f"{out}/ac").awaitTermination()
    assert [f.count() for f in streams.read_alerts(spark, f"{out}/a")] == [0, 0]
    streams.stream_quality_gate(stream(spark, empty), f"{out}/g", f"{out}/gc").awaitTermination()
    assert streams.read_gate(spark, f"{out}/g").count() == 0


def test_a_start_that_was_not_committed_is_made_again(spark, seed, inserted):
    out = shared_folder(spark, "half")
    seed.attempt.limit(3).select("student_id", "problem_id", "attempt_no").write.parquet(f"{out}/o/last_number/base--1/_bucket=0")
    found = rows(numbered(spark, inserted, out, seed.attempt.limit(0)).select("student_id", "problem_id", "attempt_no"))
    assert sorted(found) == sorted(rows(seed.attempt.select("student_id", "problem_id", "attempt_no")))


def test_a_batch_that_stops_between_two_sinks(spark, seed, inserted, monkeypatch):
    """Nothing of the batch is seen, then all of it, once."""
    out = shared_folder(spark, "stopped")
    start = lambda: streams.intake_stream(stream(spark, inserted), f"{out}/o", f"{out}/c", seed.notification)
    alerts = streams._alerts
    done = []

    def stop(batches, good, batch_id, *rest):
        if batch_id == 1 and not done:
            done.append(batch_id)
            raise RuntimeError("lost")
        return alerts(batches, good, batch_id, *rest)

    monkeypatch.setattr(streams, "_alerts", stop)
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    counts = lambda: [streams.read_numbered(spark, f"{out}/o").count(), streams.read_alerts(spark, f"{out}/o")[0].count()]
    first = counts()
    assert first[0] == 5 and Batches(spark, f"{out}/o").log.last() == 0
    start().awaitTermination()
    assert counts() == [13, writes.alert_rows(seed.attempt, seed.notification).count()]
    want = rows(seed.attempt.select("student_id", "problem_id", "attempt_no", "score"))
    assert sorted(rows(streams.read_numbered(spark, f"{out}/o").select("student_id", "problem_id", "attempt_no", "score"))) == sorted(want)
    ids = [r[0] for r in rows(streams.read_alerts(spark, f"{out}/o")[0])]
    assert sorted(ids) == list(range(11, 11 + len(ids)))


def test_intake_quarantines(spark, seed, inserted):
    out = shared_folder(spark, "intake")
    broken = stream(spark, inserted).withColumn("score", F.when(F.col("student_id") == 5, F.col("score") + 50).otherwise(F.col("score")))
    streams.intake_stream(broken, f"{out}/o", f"{out}/c", seed.notification).awaitTermination()
    refused = streams.read_quarantine(spark, f"{out}/o")
    assert refused.count() + streams.read_numbered(spark, f"{out}/o").count() == 13
    assert {r.outcome for r in refused.collect()} == {"score out of range"}
    # A refused row takes no number.
    assert streams.read_numbered(spark, f"{out}/o").where("student_id = 5").count() == seed.attempt.where("student_id = 5").count() - refused.count()


def test_batches_do_not_slow_down(spark):
    """Over many batches the files that one reads stay as few, and the numbers as right, as at first."""
    out = shared_folder(spark, "many")
    batches = Batches(spark, out)
    batches.begin(lambda: {"runs": []})
    files, total = [], {}
    for n in range(20):
        record = batches.before(n)
        pairs = [(n % 3, 7), (n, 8)]
        rows_ = spark.createDataFrame([(*p, None, None) for p in pairs], "student_id long, problem_id long, score decimal(5,2), submit_time timestamp_ntz")
        state = streams._numbers(batches)
        files.append(len(state.read(record["runs"], rows_.select("student_id", "problem_id").distinct()).inputFiles()) if record["runs"] else 0)
        done, runs = streams._numbered(batches, rows_, n, record["runs"])
        batches.commit(n, {"runs": runs})
        for pair in pairs:
            total[pair] = total.get(pair, 0) + 1
            assert done.where(f"student_id = {pair[0]} AND problem_id = {pair[1]}").first().attempt_no == total[pair]
        assert len(batches.log.numbers()) <= 2
    assert max(files[12:]) <= max(files[:12]) + 16
    assert len(runs) <= 9
    last = {tuple(r)[:2]: r[2] for r in state.largest(state.read(runs)).collect()}
    assert last == total


def test_counts_hold_a_row_for_each_author(spark, seed):
    out = shared_folder(spark, "authors")
    batches = Batches(spark, out)
    batches.begin(lambda: {"runs": []})
    for n in range(20):
        changed = spark.createDataFrame([(1, n + 1), (n, 1)], "user_id long, problems_created long")
        batches.commit(n, {"runs": streams._counts(batches).add(batches.before(n)["runs"], changed, n)})
    runs = batches.log.read(19)["runs"]
    assert streams._counts(batches).read(runs).count() <= 20 + 2 * 8
    assert dict(rows(streams.read_problem_counts(spark, out))) == {**{n: 1 for n in range(20)}, 1: 20}
