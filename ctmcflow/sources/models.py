"""Stored models, reports and datasets as tables: loads with fallbacks, CSV and JSON reports, versioned datasets."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ctmcflow.operators import ctmc

NET = "network_id"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations b, k, q, tau, pi under a folder, one Parquet table each; what is missing is derived.

    k comes from q off the diagonal, q from k and 1 / tau, b from k and tau. Neither k nor q, or no tau: an error.
    """
    got = {n: spark.read.parquet(f"{path}/{n}") for n in ("b", "k", "q", "tau", "pi") if exists(spark, f"{path}/{n}")}
    if "tau" not in got or not {"k", "q"} & set(got):
        raise FileNotFoundError(f"{path} holds neither k nor q, or no tau")
    if "k" not in got:
        got["k"] = ctmc.rates_from_generator(got["q"])
    if "q" not in got:
        got["q"] = ctmc.generator_from_rates(got["k"], got["tau"])
    if "b" not in got:
        got["b"] = ctmc.branches_from_generator(got["q"], got["tau"])
    return got


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first Parquet table of a list that is there."""
    for p in paths:
        if exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(f"none of {paths}")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report with a header, or a folder of them; columns are taken by name, those that a file lacks are null, unreadable values too."""
    raw = spark.read.csv(path, header=True)
    want = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    return raw.select(*[(F.col(f"`{n}`").try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in want])


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one object each over any number of lines, with the folder that holds each (``run``)."""
    j = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)
    return j.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))


def cached(spark: SparkSession, root: str, settings: dict, version: int, make) -> DataFrame:
    """A dataset kept under a folder named by its settings and version: read where it is there and whole, else made and written."""
    name = hashlib.sha256(json.dumps([settings, version], sort_keys=True).encode()).hexdigest()[:16]
    path = f"{root}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
