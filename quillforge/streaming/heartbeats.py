"""The queue as a stream: progress folded from log events, silent jobs swept by timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillforge.staging import fresh_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder of Parquet files, or of one file, as they arrive; event time as ``at``."""
    stream = spark.readStream.schema(EVENTS)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        # A stream watches folders: the file's own, for its name alone.
        stream, path = stream.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return stream.parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run ``stream`` over all that is there and give the rows it emitted, with their ``batch``.

    Each batch overwrites its own folder, so a batch that runs again after a failure leaves one copy.
    """
    place = fresh_path(stream.sparkSession, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    run = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return stream.sparkSession.read.schema(schema).parquet(f"{place}/rows")


def progress(events: DataFrame) -> DataFrame:
    """The last cumulative value of each (job, stage), updated as lines come in."""
    return events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("last"))


def progress_table(updates: DataFrame) -> DataFrame:
    """(user_id, stages, spend) from the updates that ``drain`` kept: the newest of each stage counts."""
    newest = updates.groupBy("user_id", "event_type").agg(F.max(F.struct("last.ts", "last.event_id", "last.value")).alias("last"))
    return newest.groupBy("user_id").agg(F.count("*").alias("stages"), F.round(F.sum("last.value"), 6).alias("spend"))


STALE = "user_id long, last_seen timestamp"


def _watch(minutes: int):  # noqa: ANN202
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (seen,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last_seen": [pd.Timestamp(seen, unit="us")]})
            return
        newest = max(int(pdf["us"].max()) for pdf in batches)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    return run


def stale_jobs(events: DataFrame, minutes: int = 10, delay: str = "0 seconds") -> DataFrame:
    """Jobs without a heartbeat for ``minutes`` of event time; one that speaks again is watched anew.

    delay: how much later than others a heartbeat may come in and still count; it delays findings as much.
    """
    beats = events.withWatermark("at", delay).select("user_id", "at", F.unix_micros("at").alias("us"))
    return beats.groupBy("user_id").applyInPandasWithState(_watch(minutes), STALE, "seen long", "append", GroupStateTimeout.EventTimeTimeout)


def weekly_quota(requests: DataFrame) -> DataFrame:
    """R9 as a stream, an extension: requests of each user in sliding windows of seven days."""
    return requests.withWatermark("at", "1 day").groupBy("user_id", F.window("at", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
