"""Session helpers shared by all operators: table access and lineage cutting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir, or the checkpoint folder of the context).

    Where none is set, a local master gets a fresh temporary one; a cluster has no folder that is safe to guess: an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    sc = spark.sparkContext._jsc.sc()
    if not sc.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().get().rstrip("/")


_open: list[Scratch] = []
_kept: dict[tuple, dict] = {}


def kept(spark: SparkSession, sf_dir: str, tables: list[str], what: str) -> dict:
    """A place for relations that several queries of a session derive from the same tables, empty at first.

    It is another one as soon as a table's files change, or after ``clean``.
    """
    jvm, state = spark.sparkContext._jvm, []
    for t in tables:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        state.append((fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()))
    key = (what, spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), shared_dir(spark), sf_dir, tuple(state))
    if key not in _kept:
        _kept[key] = {"scratch": Scratch(spark, what)}
    return _kept[key]


def clean() -> None:
    """Removes the scratch tables of this session; their frames cannot be read afterwards. Also done when Python ends."""
    _kept.clear()
    while _open:
        s = _open.pop()
        try:
            s._drop(s.root)
        except Exception:  # the session is gone, and with it the way to the folder
            return


atexit.register(clean)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``put`` writes a frame once and reads it back, so later jobs depend on files that
    survive the loss of an executor. ``keep`` bounds how many generations of one name
    stay on disk: iterative loops keep the last two.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.made: dict[str, list[str]] = {}
        _open.append(self)

    def put(self, df: DataFrame, name: str, keep: int = 0) -> DataFrame:
        paths = self.made.setdefault(name, [])
        path = f"{self.root}/{name}-{len(paths)}"
        df.write.parquet(path)
        paths.append(path)
        if keep and len(paths) > keep:
            self._drop(paths[-keep - 1])
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        for path in self.made.pop(name, []):
            self._drop(path)

    def _drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
