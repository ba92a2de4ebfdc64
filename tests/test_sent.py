from pyspark.sql import functions as F

from lanemesh import lineage


def test_written_joins_send_little_through_the_driver(spark):
    """A side that Spark would broadcast whole is not sent while a table is written; after it, the session's bound holds again."""
    before = spark.conf.get(lineage.THRESHOLD)
    n = 200_000
    left = spark.range(2 * n).withColumn("a", F.xxhash64("id"))
    right = lineage.cut(spark.range(n).withColumn("b", F.xxhash64("id")))
    joined = lambda: left.join(right, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joined()
    with lineage.little_sent(spark):
        assert "BroadcastHashJoin" not in joined()
    assert spark.conf.get(lineage.THRESHOLD) == before
    assert lineage.cut(left.join(right, "id")).count() == n and spark.conf.get(lineage.THRESHOLD) == before
