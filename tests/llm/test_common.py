from collections import Counter

from pyspark.sql import functions as F

from gaugery import scratch
from gaugery.llm import common


def test_join_groups_matches_a_left_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}", None if i % 5 else i % 2) for i in range(400)] + [(500, None, 1)], "id long, k string, j int")
    groups = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).filter("n > 10 or k = 'k1'")
    for hot in (1, 3, 1000):
        got = common.join_groups(rows, groups, ["k"], "n", F.col("id"), hot=hot)
        assert got.columns == ["id", "k", "j", "n", "top"]
        want = rows.join(groups, "k", "left").select(got.columns)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert common.join_groups(rows.limit(0), groups, ["k"], "n", F.col("id")).count() == 0


def test_hot_rows_are_dealt_out(spark):
    rows = spark.range(8000).select("id", F.lit("x").alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = common.join_groups(rows, groups, ["k"], "n", F.col("id")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
    assert max(r["count"] for r in sizes) < 4000


def test_flagged_keeps_all_that_is_wanted(spark):
    rows, wanted = spark.range(1000), spark.range(0, 1000, 50).toDF("w")
    for flags in (1, 16, 1 << 18):
        got = {r["id"] for r in common.flagged(rows, F.col("id"), wanted, flags).collect()}
        rest = {r["id"] for r in common.flagged(rows, F.col("id"), wanted, flags, "left_anti").collect()}
        assert got >= set(range(0, 1000, 50)) and got | rest == set(range(1000)) and not got & rest
    assert len(common.flagged(rows, F.col("id"), wanted).collect()) < 30


def test_samples_are_bounded_and_repeat(spark):
    labels = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(3000)] + [(None, "a"), (5000, None)], "id long, label string")
    docs = spark.range(3000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    got = common.labelled_sample(labels, docs, 256).groupBy("label").count().collect()
    assert {r["label"] for r in got} == {"a", "b"} and all(100 < r["count"] <= 256 for r in got)
    by = common.labelled_sample(labels, docs, {"a": 64, "b": 640}).groupBy("label").count().collect()
    assert {r["label"]: r["count"] <= {"a": 64, "b": 640}[r["label"]] for r in by} == {"a": True, "b": True}
    once, again = (sorted(r["text"] for r in common.labelled_sample(labels.repartition(n), docs, 100).collect()) for n in (1, 4))
    assert once == again


def test_scratch_is_the_folder_that_the_session_names(spark):
    class Session:  # the setting can't be changed in a running session
        conf = {"spark.checkpoint.dir": "hdfs://shared/ck"}

    assert scratch.scratch_root(Session) == "hdfs://shared/ck"
    assert scratch.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir", scratch.scratch_root(spark))
    assert scratch.materialise(spark.range(0), "x").count() == 0
