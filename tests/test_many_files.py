"""Folders of many small files: written, listed and read by few tasks, with any name."""

from pyspark.sql import functions as F

from ctmcflow.session import Scratch
from ctmcflow.sources import sinks, text


def test_discovery_of_many_folders_takes_few_tasks(spark):
    root = f"{Scratch(spark, 'many').root}/nets"
    names = [f"n{i}" for i in range(120)] + ["a b", "a+b", "a%2Bb", "p/q", "k=v", "ü"]
    rows = [(n, f"markov_T{t}K", "x") for n in names for t in (300, 310)] + [(None, "markov_T300K", "x"), ("n1", "markov_T300K", "x")]
    df = spark.createDataFrame(rows, "network_id string, tag string, value string")
    sinks.write_files(df.filter("network_id IS NOT NULL"), root, ["network_id", "tag"], "value")
    found = text.discover_tagged(spark, root, 300.0)
    assert sorted(r["network_id"] for r in found.collect()) == sorted(names)
    assert {r["t_k"] for r in found.collect()} == {300.0}
    paths = text._paths(spark, root)
    assert paths.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert paths.count() == 2 * len(names)
    assert spark.conf.get(text.LISTERS) == "10000"
    assert spark.read.text(root).agg(F.count_distinct("value")).collect()[0][0] == 1
