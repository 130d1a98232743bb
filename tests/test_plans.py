"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from classmeter.operators import admin, kept, learner, mentor, quality, reports, writes
from classmeter.plans.catalog import QUERIES
from classmeter.sources.binding import MENTORS
from conftest import SF



def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def jobs_plans(build):
    """The plans of all that runs while a query is built, streams' micro-batches included."""
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def spy(self, *args, **options):
        plans.append(plan_of(self._df))
        return write(self, *args, **options)

    DataFrameWriter.parquet = spy
    try:
        frame = build()
    finally:
        DataFrameWriter.parquet = write
    return [*plans, plan_of(frame)]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_products_and_no_python(spark, key):
    for plan in jobs_plans(lambda: QUERIES[key](spark, SF)):
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups|TransformWithState", plan)


@pytest.mark.parametrize(
    "key, scans", [("apply_feedback", 2), ("append_attempts", 3), ("set_status", 2), ("dismiss_notification", 2)]
)
def test_a_delta_is_computed_once(spark, key, scans):
    """The delta's own lineage is read for the one write; what comes after reads the written table."""
    *writes_, last = jobs_plans(lambda: QUERIES[key](spark, SF))
    assert writes_ and "FileScan" in writes_[0]
    assert last.count("lineitem.parquet") <= scans


def snapshot(spark, bound):
    from classmeter.session import shared_folder
    from classmeter.sources import tables

    path = shared_folder(spark, "snapshot")
    tables.write_snapshot(bound, path)
    return tables.load(spark, path)


@pytest.fixture(scope="module")
def loaded(spark, bound):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # plans show whole paths
    yield snapshot(spark, bound)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize(
    "frame, fact",
    [
        (lambda t: mentor.my_problems(t, MENTORS + 1), "attempt"),
        (lambda t: mentor.feedback_given(t, MENTORS + 1), "attempt"),
        (lambda t: mentor.my_resources(t, MENTORS + 1), "access"),
        (lambda t: admin.inbox(t, 7), "send"),
    ],
)
def test_an_owner_s_keys_meet_the_fact_table_first(loaded, frame, fact):
    """On a written snapshot the semi-join is below every aggregate and other join of the fact table."""
    above: list[str] = []
    for line in plan_of(frame(loaded)).split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        above = [(d, n) for d, n in above if d < depth] + [(depth, line.strip(" :+-*()0123456789"))]
        if "FileScan" in line and f"/{fact}/" in line:
            joins = [n for _, n in above if re.search("Join|Aggregate", n)]
            assert "LeftSemi" in joins[-1], joins
            return
    raise AssertionError(f"no scan of {fact}")


def test_each_child_is_read_once(loaded):
    used, last = jobs_plans(lambda: quality.orphan_check(loaded))
    for child in ("attempt", "access", "send", "receive", "have_topic", "resourcetopic"):
        assert len(re.findall(rf"FileScan[^\n]*/{child}/", used)) == 1
    assert len(re.findall(r"FileScan[^\n]*/problem/", used)) == 2  # as a child and as a parent
    assert "SortAggregate" not in used and "ObjectHashAggregate" not in used
    assert not re.search(r"FileScan", last)  # nothing is broken


def test_broken_rows_alone_are_shuffled(loaded):
    """What holds broken references is read again, and meets them without a shuffle of its rows."""
    far = loaded.replace(attempt=loaded.attempt.withColumn("mentor_id", F.col("mentor_id") + 10**13))
    _, last = jobs_plans(lambda: quality.orphan_check(far))
    assert len(re.findall(r"FileScan[^\n]*/attempt/", last)) == 1 and "/access/" not in last
    assert "BroadcastHashJoin" in last and "SortMergeJoin" not in last


def test_a_cascade_reads_a_relation_twice_and_joins_it_once(loaded):
    gone = loaded.user.filter("status = 'banned'").select("user_id")
    removal = []
    plans = jobs_plans(lambda: removal.append(writes.plan_removal(loaded, gone, guard=False)) or loaded.user)[:-1]
    for relation in ("attempt", "problem", "access"):
        scans = [len(re.findall(rf"FileScan[^\n]*/{relation}/", plan)) for plan in plans]
        assert sum(scans) == 1, (relation, scans)
    left = writes.without_removed(loaded, removal[0])
    for relation in ("attempt", "problem", "access", "receive"):
        plan = plan_of(left[relation])
        assert len(re.findall(rf"FileScan[^\n]*/{relation}/", plan)) == 1 and len(re.findall(r"\w+Join ", plan)) == 1


def test_kept_counts_follow_without_the_attempts(loaded):
    counts = kept.build(loaded)
    new = loaded.attempt.limit(50)
    written = jobs_plans(lambda: kept.fold(counts, kept.added(attempt=new))["tries"])
    assert sum("/attempt/" in plan for plan in written) == 3 and "/attempt/" not in written[-1]
    assert "SortMergeJoin" not in written[-1]  # the counts are not shuffled
    for view in (kept.student_performance, kept.problem_statistics, kept.mentor_activity):
        assert "/attempt/" not in plan_of(view(loaded, counts))


def test_aggregates_hash(bound):
    for frame in (learner.latest_score(bound), quality.vocabulary_rule(bound.resource, "resource")):
        assert "SortAggregate" not in plan_of(frame)


def test_scans_are_narrow_and_filtered(bound):
    plan = plan_of(reports.first_attempt_failures(bound))
    scan = re.search(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem[^\n]*", plan)
    assert len(scan.group(1).split(",")) == 4 and "EqualTo(l_linenumber,1)" in scan.group(0)
    dated = plan_of(learner.my_attempts(bound, date_from="1997-01-01", date_to="1999-12-31"))
    assert "GreaterThanOrEqual(l_shipdate" in dated and "LessThan(l_shipdate" in dated


def test_top_n_is_limited_before_the_shuffle(bound):
    for frame in (
        learner.recent_attempts(bound), mentor.pending_reviews(bound), mentor.recent_problems(bound),
        mentor.recent_attempts_of_problem(bound),
    ):
        plan = plan_of(frame)
        assert re.search(r"WindowGroupLimit[^\n]*Partial", plan)
    assert "TakeOrderedAndProject" in plan_of(reports.top_students(bound))


def test_one_student_is_filtered_before_aggregation(bound):
    plan = plan_of(learner.student_summary(bound, 7))
    assert "EqualTo(o_custkey,7)" in plan
