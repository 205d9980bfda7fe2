"""Sinks: text files by network, keep lists, union-schema reports, tables by network."""

from __future__ import annotations

import contextlib
import os
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def cut_label(c: Column) -> Column:
    """dE{:.2f} with p for the point."""
    return F.regexp_replace(F.format_string("dE%.2f", c.cast("double")), "\\.", "p")


def write_lines(df: DataFrame, path: str, columns: list[str], order: list[str], mode: str = "errorifexists") -> None:
    """One text folder per network (network_id=...), lines in the given order within each file."""
    line = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])
    df.repartition("network_id").sortWithinPartitions("network_id", *order).select("network_id", line.alias("value")).write.partitionBy("network_id").mode(mode).text(path)


def write_keep_lists(kept: DataFrame, path: str, overwrite: bool = False) -> None:
    """kept(network_id, cut, node): a text folder per network and cut label with the kept numbers in order; a list that is there stays unless told."""
    out = kept.select("network_id", cut_label(F.col("cut")).alias("label"), F.col("node").cast("string").alias("value"), "node")
    out.repartition("network_id", "label").sortWithinPartitions("network_id", "label", "node").drop("node").write.partitionBy("network_id", "label").mode("overwrite" if overwrite else "ignore").text(path)


def write_files(df: DataFrame, root: str, folders: list[str], value: str) -> None:
    """A file of the column ``value`` in the folder that ``folders`` name (a=../b=..) for each of df's distinct rows; rows of one folder share it.

    Folders of the local file system, which executors share, are filled by Python: Hadoop's would start a process or two for each file.
    """
    df = df.select(*folders, value).distinct()
    spark, place = df.sparkSession, df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() != "file":
        return df.repartition(*folders).write.partitionBy(*folders).text(root)
    local = place.toUri().getPath()
    part = [F.concat(F.lit(f"{c}="), F.url_encode(F.col(c).cast("string"))) for c in folders]
    os.makedirs(local, exist_ok=True)
    rows = df.groupBy(F.replace(F.concat_ws("/", *part), F.lit("+"), F.lit("%20")).alias("folder")).agg(F.collect_list(value).alias("lines"))

    def fill(batches):
        for pdf in batches:
            for folder, lines in zip(pdf["folder"], pdf["lines"]):
                at = local
                for x in folder.split("/"):
                    at = f"{at}/{x}"
                    with contextlib.suppress(FileExistsError):
                        os.mkdir(at)
                with open(f"{local}/{folder}/part.txt", "w", encoding="utf-8") as f:
                    f.writelines(f"{x}\n" for x in lines)
        yield pd.DataFrame({"n": []})

    rows.mapInPandas(fill, "n long").write.format("noop").mode("overwrite").save()


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metrics rows as JSON, one folder per run (column ``run``)."""
    df.write.partitionBy("run").mode(mode).json(path)


def write_by_network(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by network; a large network is spread over files by a salt, a small one is one file."""
    df.repartition("network_id", F.pmod(F.xxhash64(*df.columns), F.lit(4))).write.partitionBy("network_id").mode(mode).parquet(path)


def union_reports(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(frames: list[DataFrame], path: str, mode: str = "errorifexists") -> None:
    union_reports(frames).write.mode(mode).csv(path, header=True)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Resume: only rows whose key the sink does not hold are added."""
    try:
        done = df.sparkSession.read.parquet(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as e:  # the sink does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").parquet(path)
