"""Running totals that scale: spend caps, counters and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, order: list[str], value: str, bucket: Column, name: str = "total") -> DataFrame:
    """Adds the sum of ``value`` up to each row, all rows in ``order``.

    bucket: a coarse value that never falls along ``order``, such as a day. Windows run inside a
    bucket; the one over all buckets sees a row for each of them.
    """
    own = rows.withColumn("_bucket", bucket)
    sums = own.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    before = sums.select("_bucket", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_inside", inside).join(before, "_bucket").withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def within_cap(rows: DataFrame, order: list[str], cost: str, cap: float, bucket: Column) -> DataFrame:
    """Rows up to and with the one whose running cost first passes ``cap`` (reaching it isn't passing)."""
    return running_total(rows, order, cost, bucket, "spent").where(F.col("spent") - F.col(cost) <= cap)


def counter_rollup(rows: DataFrame, job: str, stage: str, order: list[str], spend: str) -> DataFrame:
    """(job, stages, spend): each stage's last cumulative value, summed over the job's stages."""
    last = rows.groupBy(job, stage).agg(F.max(F.struct(*order, spend)).alias("last"))
    return last.groupBy(job).agg(F.count("*").alias("stages"), F.sum(f"last.{spend}").alias("spend"))


def tail(rows: DataFrame, key: str, order: list[Column], n: int = 30) -> DataFrame:
    """Each key's last ``n`` rows; the rank limit is pushed below the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
