"""Uneven joins."""

import pytest
from pyspark.sql import functions as F

from classmeter.functions.joins import left_join_sparse
from classmeter.session import written
from conftest import rows


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ids_match_and_nulls_do_not(spark, shuffled):
    left = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    right = spark.createDataFrame([(0, "a"), (20, "b"), (7, "c"), (-5, "d"), (-65_536, "e"), (None, "f")], "k long, v string")
    found = left_join_sparse(left, right, "k", ["id"])
    assert found.columns == ["k", "id", "v"] and found.count() == 1000
    assert sorted(rows(found.filter("v is not null").select("id", "k", "v"))) == [(0, 0, "a"), (20, 20, "b")]
    assert found.filter("k is null").count() == 900


def test_negative_ids_are_ids(spark, shuffled):
    left = spark.range(50_000).select("id", F.when(F.col("id") == 7, F.lit(-5).cast("long")).alias("k"))
    right = spark.createDataFrame([(i, "x") for i in range(-100, 0)], "k long, v string")
    assert rows(left_join_sparse(left, right, "k", ["id"]).filter("v is not null").select("id", "k")) == [(7, -5)]


def test_nulls_are_spread_by_the_salt(spark, shuffled):
    left = spark.range(100).select("id", F.lit(None).cast("long").alias("k"))
    right = written(spark.createDataFrame([(1, "x")], "k long, v string"), "right")
    plan = plan_of(left_join_sparse(written(left, "left"), right, "k", ["id"]))
    assert plan.count("hashpartitioning(k") >= 2 and "_salt" in plan.split("SortMergeJoin")[1].split("LeftOuter")[0]


def test_a_written_table_has_a_size(spark):
    few = spark.range(10).select("id", F.lit("x").alias("text")).groupBy("id").agg(F.max("text").alias("text"))
    big = written(spark.range(100_000).withColumn("k", F.col("id") % 7), "big")
    assert "BroadcastHashJoin" in plan_of(big.join(written(few, "few"), "id"))
