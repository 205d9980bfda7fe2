"""Text sources of stationary points and id lists, read as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MINIMA = [("energy", "double"), ("log_prod", "double"), ("dd", "int"), ("rx", "double"), ("ry", "double"), ("rz", "double")]
TS = [("e_ts", "double"), ("s_ts", "double"), ("dd", "int"), ("f", "long"), ("i", "long"), ("rx", "double"), ("ry", "double"), ("rz", "double")]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and place in it. Files are small beside the folder, so the place is counted per file."""
    t = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"))
    return t.withColumn("_i", F.monotonically_increasing_id())


def _fields(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    parts = F.split(F.trim("value"), "\\s+")
    return df.withColumns({n: F.get(parts, F.lit(k)).try_cast(t) for k, (n, t) in enumerate(spec)})


def _network(df: DataFrame) -> DataFrame:
    """network_id: the folder that holds the file, without _nocap; a partition folder network_id=... gives its value."""
    folder = F.try_url_decode(F.regexp_extract("file", "([^/]+)/[^/]+$", 1))
    value = F.try_url_decode(F.regexp_extract(folder, "^network_id=(.*)$", 1))
    return df.withColumn("network_id", F.regexp_replace(F.when(folder.startswith("network_id="), value).otherwise(folder), "_nocap$", ""))


def scan_minima(spark: SparkSession, path: str) -> DataFrame:
    """network_id, min_id (1-based line), and the six columns. Blank lines, comments and lines without an energy are skipped."""
    t = _network(_fields(_lines(spark, path), MINIMA)).filter("energy IS NOT NULL AND NOT startswith(trim(value), '#')")
    return t.withColumn("min_id", F.row_number().over(Window.partitionBy("file").orderBy("_b", "_i")).cast("long")).select("network_id", "min_id", *[n for n, _ in MINIMA])


def scan_ts(spark: SparkSession, path: str) -> DataFrame:
    """network_id, ts_id and the eight columns; f and i stay 1-based. Malformed lines are skipped."""
    t = _network(_fields(_lines(spark, path), TS)).filter("e_ts IS NOT NULL AND f IS NOT NULL AND i IS NOT NULL AND NOT startswith(trim(value), '#')")
    return t.withColumn("ts_id", F.row_number().over(Window.partitionBy("file").orderBy("_b", "_i")).cast("long")).select("network_id", "ts_id", *[n for n, _ in TS])


def scan_ids(spark: SparkSession, path: str) -> DataFrame:
    """network_id, min_id of id lists; a leading count (equal to the number of ids that follow) is left out."""
    t = _network(_lines(spark, path)).select("network_id", "file", "_b", "_i", F.posexplode(F.split(F.trim("value"), "\\s+")).alias("pos", "x"))
    t = t.withColumn("min_id", F.col("x").try_cast("long")).filter("min_id IS NOT NULL")
    w = Window.partitionBy("file")
    t = t.withColumn("rn", F.row_number().over(w.orderBy("_b", "_i", "pos"))).withColumn("n", F.count("*").over(w))
    return t.filter("NOT (rn = 1 AND min_id = n - 1)").select("network_id", "min_id")


LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _paths(spark: SparkSession, root: str) -> DataFrame:
    """path of every file under root. Folders are listed, and files taken, by a few tasks a core: by default a folder each, and four files each."""
    n, was = 4 * spark.sparkContext.defaultParallelism, spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, n)
    try:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)  # lists at once
    finally:
        spark.conf.set(LISTERS, was)
    return f.select("path").coalesce(n)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """network_id and folder of every directory under root that holds both min.data and ts.data."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.data").load(root).select("path")
    f = f.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    g = f.groupBy("folder").agg(F.collect_set("name").alias("names")).filter("array_contains(names, 'min.data') AND array_contains(names, 'ts.data')")
    return g.select(F.regexp_replace(F.regexp_extract("folder", "([^/]+)$", 1), "_nocap$", "").alias("network_id"), "folder")


def scan_first_ids(spark: SparkSession, path: str) -> DataFrame:
    """network_id, min_id: the first integer of every line; blank lines, comments and lines that start otherwise are skipped."""
    t = _network(_lines(spark, path)).withColumn("min_id", F.regexp_extract(F.trim("value"), "^([-+]?\\d+)(?=\\s|$)", 1).try_cast("long"))
    return t.filter("min_id IS NOT NULL").select("network_id", "min_id")


def discover_tagged(spark: SparkSession, root: str, only_t: float | None = None) -> DataFrame:
    """network_id, t_k, folder of every folder markov_T<kelvin>K below root that holds a file; only those of one temperature where given."""
    f = _paths(spark, root)
    f = f.select(F.regexp_extract("path", "^(.*/(?:tag=)?markov_T[0-9.p]+K)/", 1).alias("folder")).filter("folder <> ''").distinct()
    t = F.replace(F.regexp_extract("folder", "markov_T([0-9.p]+)K$", 1), F.lit("p"), F.lit(".")).try_cast("double")
    f = f.withColumn("t_k", t).withColumn("network_id", F.regexp_replace(F.try_url_decode(F.regexp_extract("folder", "(?:network_id=)?([^/=]+)/(?:tag=)?markov_T[^/]+$", 1)), "_nocap$", ""))
    return (f if only_t is None else f.filter(F.abs(F.col("t_k") - only_t) < 1e-9)).select("network_id", "t_k", "folder")
