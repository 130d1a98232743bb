"""Streaming forms of the insert-time rules.

Every stream writes folders per micro-batch and one commit record for all of
them (see `batches`), so a restart after a lost executor or driver leaves no
duplicates, and a reader sees a batch whole or not at all. Folders are read back
with a declared schema, so a stream without output reads as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from classmeter.functions.numbering import number_within
from classmeter.operators.quality import feedback_missing, score_outside
from classmeter.operators.writes import PAIR, alert_rows, running_problem_counts
from classmeter.session import written
from classmeter.sources.schemas import SCHEMAS
from classmeter.streaming.batches import Batches, State

ALERTS = T.StructType().add("noti_id", "long").add("send_time", "timestamp_ntz").add("receiver_id", "long")
LAST_ID = T.StructType().add("noti_id", "long")
COUNTS = T.StructType().add("user_id", "long").add("problems_created", "long")
ATTEMPT = T.StructType([*SCHEMAS["attempt"]])
QUARANTINE = T.StructType([*ATTEMPT, T.StructField("outcome", T.StringType())])
LAST_NUMBER = T.StructType().add("student_id", "long").add("problem_id", "long").add("attempt_no", "integer")
NUMBERED = T.StructType().add("student_id", "long").add("problem_id", "long").add(
    "score", "decimal(5,2)"
).add("submit_time", "timestamp_ntz").add("attempt_no", "integer")


def _started(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _each(batches: Batches, run: Callable[[DataFrame, int], dict]) -> Callable[[DataFrame, int], None]:
    """Run and commit each batch that is not committed yet."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batches.done(batch_id):
            batches.commit(batch_id, run(batch, batch_id))

    return write


def _last_id(notification: DataFrame) -> int:
    return notification.agg(F.coalesce(F.max("noti_id"), F.lit(0)).cast("long")).first()[0]


def _alerts(batches: Batches, good: DataFrame, batch_id: int, last: int, mark: int, now: Column | None) -> int:
    """Write the alerts of a batch; the last id after it."""
    before = batches.spark.createDataFrame([(last,)], LAST_ID)
    rows = alert_rows(good, before, mark).select(
        "noti_id",
        (F.current_timestamp() if now is None else now).cast("timestamp_ntz").alias("send_time"),
        F.col("student_id").alias("receiver_id"),
    )
    done = batches.write(rows, "alerts", batch_id, ALERTS)
    return max(last, _last_id(done))


def high_score_stream(
    attempts: DataFrame,
    notification: DataFrame,
    out: str,
    checkpoint: str,
    mark: int = 90,
    now: Column | None = None,
) -> StreamingQuery:
    """Write an alert (noti_id, send_time, receiver_id) for each good new attempt.

    Ids go on from `notification`, which is looked up once, when the stream is
    first started. The last id stands in the record of each batch, and a batch
    starts from the record before it, so a repeat gives the same.
    """
    batches = Batches(attempts.sparkSession, out)
    batches.begin(lambda: {"noti_id": _last_id(notification)})

    def run(batch: DataFrame, batch_id: int) -> dict:
        return {"noti_id": _alerts(batches, batch, batch_id, batches.before(batch_id)["noti_id"], mark, now)}

    return _started(attempts.writeStream.foreachBatch(_each(batches, run)), checkpoint)


def read_alerts(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(notification rows, receive rows) written by `high_score_stream`."""
    rows = Batches(spark, out).read("alerts", ALERTS)
    return rows.select("noti_id", "send_time"), rows.select("receiver_id", "noti_id")


def _counts(batches: Batches) -> State:
    return State(batches, "counts", ["user_id"], "problems_created", COUNTS)


def problem_count_stream(problems: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running number of inserted problems per author; a batch adds the changed ones to a state of bounded runs."""
    batches = Batches(problems.sparkSession, out)
    batches.begin(lambda: {"runs": []})

    def run(batch: DataFrame, batch_id: int) -> dict:
        return {"runs": _counts(batches).add(batches.before(batch_id)["runs"], batch, batch_id)}

    counts = running_problem_counts(problems)
    return _started(counts.writeStream.outputMode("update").foreachBatch(_each(batches, run)), checkpoint)


def read_problem_counts(spark: SparkSession, out: str) -> DataFrame:
    """The newest count of each author; counts never fall."""
    batches = Batches(spark, out)
    last = batches.log.last()
    state = _counts(batches)
    return state.largest(state.read([] if last is None else batches.log.read(last)["runs"]))


def _judged(batch: DataFrame) -> DataFrame:
    holds = lambda rule: F.coalesce(rule, F.lit(False))
    outcome = (
        F.when(holds(feedback_missing()), "feedback required")
        .when(holds(score_outside()), "score out of range")
        .otherwise("valid")
    )
    return batch.select(*ATTEMPT.names).withColumn("outcome", outcome)


def stream_quality_gate(attempts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Valid attempts into one sink, the others with the rule they break into a quarantine."""
    batches = Batches(attempts.sparkSession, out)
    batches.begin(dict)

    def run(batch: DataFrame, batch_id: int) -> dict:
        judged = _judged(batch)
        batches.write(judged.filter("outcome = 'valid'"), "valid", batch_id, ATTEMPT)
        batches.write(judged.filter("outcome <> 'valid'"), "quarantine", batch_id, QUARANTINE)
        return {}

    return _started(attempts.writeStream.foreachBatch(_each(batches, run)), checkpoint)


def read_valid(spark: SparkSession, out: str) -> DataFrame:
    """The attempts that passed `stream_quality_gate`."""
    return Batches(spark, out).read("valid", ATTEMPT)


def read_quarantine(spark: SparkSession, out: str) -> DataFrame:
    """The attempts that a gate refused, with the rule that each breaks."""
    return Batches(spark, out).read("quarantine", QUARANTINE)


def read_gate(spark: SparkSession, out: str) -> DataFrame:
    """Both sinks of `stream_quality_gate`, with the outcome of each attempt."""
    return read_valid(spark, out).withColumn("outcome", F.lit("valid")).union(read_quarantine(spark, out))


def _numbers(batches: Batches) -> State:
    return State(batches, "last_number", PAIR, "attempt_no", LAST_NUMBER)


def _numbered(batches: Batches, batch: DataFrame, batch_id: int, runs: list[str]) -> tuple[DataFrame, list[str]]:
    """(the numbered attempts of a batch, as written; the runs after it)."""
    score = F.col("score").cast("decimal(5,2)").alias("score")
    order = [F.asc_nulls_last("submit_time"), F.asc("score")]
    arrived = written(batch.select(*PAIR, score, "submit_time"), "arrived")
    rows = number_within(arrived, PAIR, order, "_n", settled=True)
    state = _numbers(batches)
    before = state.largest(state.read(runs, arrived.select(*PAIR))).withColumnRenamed("attempt_no", "_before")
    number = (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("int").alias("attempt_no")
    done = rows.join(before, PAIR, "left").select(*PAIR, "score", "submit_time", number)
    done = batches.write(done, "attempts", batch_id, NUMBERED)
    return done, state.add(runs, done, batch_id)


def numbering_stream(
    scored: DataFrame, out: str, checkpoint: str, last: DataFrame | None = None
) -> StreamingQuery:
    """Write new attempts with running numbers per student and problem.

    A micro-batch is numbered in time order by the batch operator, however many
    of its rows are of one pair, and its numbers go on from those of the
    batches before. A narrow state holds the last number of each pair: `last`
    (student_id, problem_id, attempt_no) becomes its base once, when the stream
    is first started, and a batch reads the buckets of its own pairs.
    """
    batches = Batches(scored.sparkSession, out)
    batches.begin(lambda: {"runs": [] if last is None else [_numbers(batches).write_run(last, -1, "base")]})

    def run(batch: DataFrame, batch_id: int) -> dict:
        return {"runs": _numbered(batches, batch, batch_id, batches.before(batch_id)["runs"])[1]}

    return _started(scored.writeStream.foreachBatch(_each(batches, run)), checkpoint)


def read_numbered(spark: SparkSession, out: str) -> DataFrame:
    """The attempts written by `numbering_stream` or `intake_stream`."""
    return Batches(spark, out).read("attempts", NUMBERED)


def intake_stream(
    attempts: DataFrame,
    out: str,
    checkpoint: str,
    notification: DataFrame,
    last: DataFrame | None = None,
    mark: int = 90,
    now: Column | None = None,
) -> StreamingQuery:
    """All insert rules in a row: gate, numbers for what passes it, alerts for good scores.

    Three sinks (`read_numbered`, `read_quarantine`, `read_alerts`) and the state
    of the numbers are committed together for each batch.
    """
    batches = Batches(attempts.sparkSession, out)
    batches.begin(
        lambda: {
            "noti_id": _last_id(notification),
            "runs": [] if last is None else [_numbers(batches).write_run(last, -1, "base")],
        }
    )

    def run(batch: DataFrame, batch_id: int) -> dict:
        before = batches.before(batch_id)
        judged = _judged(batch)
        batches.write(judged.filter("outcome <> 'valid'"), "quarantine", batch_id, QUARANTINE)
        done, runs = _numbered(batches, judged.filter("outcome = 'valid'"), batch_id, before["runs"])
        return {"noti_id": _alerts(batches, done, batch_id, before["noti_id"], mark, now), "runs": runs}

    return _started(attempts.writeStream.foreachBatch(_each(batches, run)), checkpoint)
