"""A Markov chain of event types estimated from an event stream (an extension beside the network operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_steps(events: DataFrame) -> DataFrame:
    """Each event with the user's next one: src, dst, dwell in microseconds; a user's last event has none.

    Steps are made within a user's hours, and the last event of an hour meets the first one of the user's next hour, so no
    task sorts a whole user who has a third of all events; only hours, not events, are lined up by user.
    """
    hour = ["user_id", "_h"]
    e = events.select("user_id", "event_id", "event_type", F.unix_micros(F.to_timestamp("ts")).alias("t")).withColumn("_h", F.floor(F.col("t") / 3_600_000_000))
    w = Window.partitionBy(*hour).orderBy("t", "event_id")
    inner = e.select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), "t", F.lead("t").over(w).alias("t2")).filter("dst IS NOT NULL")
    key = F.struct("t", "event_id", "event_type")
    ends = e.groupBy(*hour).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    nxt = F.lead("first").over(Window.partitionBy("user_id").orderBy("_h"))
    across = ends.withColumn("next", nxt).filter("next IS NOT NULL").select("user_id", F.col("last.event_type").alias("src"), F.col("next.event_type").alias("dst"), F.col("last.t").alias("t"), F.col("next.t").alias("t2"))
    return inner.unionByName(across).select("user_id", "src", "dst", (F.col("t2") - F.col("t")).alias("dwell"))


def event_chain(events: DataFrame) -> DataFrame:
    """Counts, mean dwell (seconds) and branching of every step of event types."""
    c = event_steps(events).groupBy("src", "dst").agg(F.count("*").alias("n"), F.avg(F.col("dwell") / 1e6).alias("dwell_s"))
    total = c.groupBy("src").agg(F.sum("n").alias("t"))
    return c.join(total, "src").select("src", "dst", "n", F.round("dwell_s", 3).alias("dwell_s"), F.round(F.col("n") / F.col("t"), 6).alias("b"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emits the steps of one user from sorted lists of events; the state holds the last event."""
    rows = sorted(x for b in batches for run in b["run"] for x in ((r["t"], r["event_id"], r["event_type"]) for r in run))
    last = state.get if state.exists else None
    out = []
    for us, _, kind in rows:
        if last is not None:
            out.append((key[0], last[1], kind, us - last[0]))
        last = (us, kind)
    state.update(last)
    yield pd.DataFrame(out, columns=["user_id", "src", "dst", "dwell"])


def stream_steps(events: DataFrame) -> DataFrame:
    """Steps of a streaming frame of events, one state per user; a micro-batch must hold no more of a user than a task can.

    ``run_stream`` bounds its micro-batches by the files they read.
    """
    one = F.array(F.struct(F.unix_micros("ts").alias("t"), "event_id", "event_type")).alias("run")
    return events.select("user_id", one).groupBy("user_id").applyInPandasWithState(_advance, "user_id long, src string, dst string, dwell long", "us long, kind string", "append", GroupStateTimeout.NoTimeout)


def run_stream(spark: SparkSession, folder: str, glob: str, out: str, checkpoint: str, files: int = 8) -> DataFrame:
    """Reads the event files there are as a stream, at most ``files`` in a micro-batch, and writes their steps; returns what was written.

    Files must come in the order of time, as an event log's do.
    """
    events = spark.readStream.schema(spark.read.parquet(f"{folder}/{glob}").schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)
    events = events.select("event_id", F.to_timestamp("ts").alias("ts"), "user_id", "event_type")
    q = stream_steps(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def windowed_counts(events: DataFrame, late: str = "1 hour", length: str = "6 hours") -> DataFrame:
    """Events and mean value by type in tumbling windows; works on streams, where the watermark bounds the state."""
    e = events.withColumn("at", F.to_timestamp("ts"))
    if events.isStreaming:
        e = e.withWatermark("at", late)
    return e.groupBy(F.window("at", length)["start"].alias("start"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
