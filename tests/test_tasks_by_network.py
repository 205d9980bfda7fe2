"""Networks of little data and much work are not put together in one task."""

from pyspark.sql import functions as F

from ctmcflow.operators import reduce
from ctmcflow.session import Scratch


def test_reductions_of_small_networks_are_spread(spark):
    rows = [(f"n{i}", s, d, 0.5, 0.5, 0.5) for i in range(24) for s in range(3) for d in range(3) if s != d]
    edges = spark.createDataFrame(rows, reduce.EDGES)
    keep = edges.filter("src < 2").select("network_id", F.col("src").alias("node")).distinct()
    made = reduce.transform(Scratch(spark, "tasks"), edges, keep)
    assert made.select("network_id").distinct().count() == 24
    modes = reduce.spectrum(edges).withColumn("task", F.spark_partition_id())
    assert modes.select("task").distinct().count() >= 12
