"""Broadcast decisions, row numbers, intermediate tables."""

import os

from pyspark.sql import functions as F

from strandlake import runtime


def broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_a_side_is_broadcast_by_its_bytes(spark):
    """Few rows that are long don't travel to every task, nor do many that are short."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(1000).withColumn("x", F.col("id") * 2)
        small = spark.range(100).withColumn("text", F.lit("a" * 50))
        assert runtime.is_small(small) and not runtime.is_small(small, 5000) and runtime.is_small(small.limit(0), 0)
        for limit, way in ((None, True), (5000, False), (100, False)):
            joined = runtime.join_small(big, small, "id", limit=limit)
            assert broadcasts(joined) is way and joined.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_tables_are_of_the_application_and_can_be_released(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(runtime, "shared_dir", lambda _: str(tmp_path))
    df = runtime.materialize(spark.range(10))
    own = runtime.own_dir(spark)
    assert spark.sparkContext.applicationId in own and df.count() == 10 and os.listdir(f"{own}/tables")
    runtime.release(spark)
    assert not os.path.exists(f"{own}/tables") and runtime.materialize(spark.range(3)).count() == 3


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)] + [(None, "y")], "a int, b string")
    rows = sorted((r.n, r.a) for r in runtime.numbered(df, ["a", "b"], "n", 1).collect())
    assert [n for n, _ in rows] == list(range(1, 52)) and [a for _, a in rows] == [None, *range(50)]
    assert runtime.numbered(df.limit(0), ["a"], "n").isEmpty()
