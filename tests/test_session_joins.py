"""Session settings for clusters and the size-checked join."""

from pyspark.sql import functions as F

from phonelens.functions.joins import join_bounded
from phonelens.session import cluster_conf


def test_cluster_conf_sizes_partitions_by_bytes():
    conf = cluster_conf(input_bytes=100 * 1024 ** 4, cores=8000, checkpoint_dir="hdfs:///ckpt")
    assert int(conf["spark.sql.shuffle.partitions"]) == 20_000
    assert conf["spark.sql.adaptive.enabled"] == "true" and conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert conf["spark.checkpoint.dir"] == "hdfs:///ckpt"
    small = cluster_conf(input_bytes=1024, cores=16, checkpoint_dir="/shared")
    assert int(small["spark.sql.shuffle.partitions"]) == 48


def _plan(df):
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString().split("== Initial Plan ==")[0]


def test_join_bounded_broadcasts_only_small_sides(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")    # only the explicit hint may broadcast
    try:
        big = spark.range(0, 5000).select((F.col("id") % 5).alias("fold"), "id")
        small = spark.range(0, 5).select(F.col("id").alias("fold"), (F.col("id") * 10).alias("x"))
        hinted = join_bounded(big, small, "fold", max_rows=10)
        assert "BroadcastHashJoin" in _plan(hinted) and hinted.count() == 5000
        shuffled = join_bounded(big, small, "fold", max_rows=2)
        assert "BroadcastHashJoin" not in _plan(shuffled) and shuffled.count() == 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
