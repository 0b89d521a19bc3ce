"""Streaming queries, each against the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.plans.registry import query
from quillforge.streaming import heartbeats


@query("""with l as (select user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1)
select user_id, count(*) as stages, round(sum(value), 6) as spend from l group by 1""")
def q_stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress folded from a stream of lines."""
    stream = heartbeats.event_stream(spark, f"{sf_dir}/events.parquet")
    return heartbeats.progress_table(heartbeats.drain(heartbeats.progress(stream), "progress", "update"))


@query("select user_id, max(ts) as last_seen from events group by 1 having max(ts) + interval 10 minute < (select max(ts) from events)")
def q_stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent jobs found by event-time timeouts."""
    stream = heartbeats.event_stream(spark, f"{sf_dir}/events.parquet")
    found = heartbeats.drain(heartbeats.stale_jobs(stream), "stale", "append")
    return found.groupBy("user_id").agg(F.max("last_seen").cast("timestamp_ntz").alias("last_seen"))
