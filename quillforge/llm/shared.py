"""Session plumbing shared by the training-data operators: staging, Arrow batches, table access."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.session import table
from quillforge.staging import drop_staged, fresh_path
from quillforge.staging import staged as stage

__all__ = ["bound_arrow", "drop_staged", "fresh_path", "frequent", "kept", "let_go", "salted_join", "stage", "table"]

#: Rows of one Arrow batch handed to Python: bounds worker memory at this many texts.
ARROW_ROWS = 512
#: A value that more than one of this many rows have is frequent; there can't be more such values.
FREQUENT = 1000
#: How many ways the rows of a frequent value are split in a join.
WAYS = 16


#: What a worker keeps between tasks: one thing at a time.
_KEPT: dict[tuple, Any] = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The thing of this key that the worker has made before, or a new one; it takes the place of any other."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Free what another operator's tasks have left in this worker."""
    _KEPT.clear()


def bound_arrow(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small enough for long texts; a smaller setting of the session stays.

    Workers that start from now on also find this package where the driver does.
    """
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def frequent(counts: DataFrame, total: int, n: str = "n") -> DataFrame:
    """The rows of ``counts`` whose ``n`` is over 1 in FREQUENT of ``total``: at most FREQUENT rows, as the
    counts sum up to the total, hence small enough to broadcast."""
    return counts.where(F.col(n) > max(total // FREQUENT, FREQUENT // 10))


def salted_join(rows: DataFrame, key: str, total: int, other: DataFrame, ways: int = WAYS) -> DataFrame:
    """``rows`` inner-joined by ``key`` to ``other``, rows of frequent keys dealt over ``ways`` tasks each.

    total: how many rows there are. The key is unique in other, whose rows of frequent keys go to all
    their tasks. rows is read twice, so it should be staged.
    """
    hot = F.broadcast(frequent(rows.groupBy(key).agg(F.count("*").alias("n")), total).select(F.col(key).alias("_hot")))
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(ways)).cast("int")).otherwise(0)
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    copies = F.sequence(F.lit(0), F.when(F.col("_hot").isNotNull(), F.lit(ways - 1)).otherwise(0))
    spread = other.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return dealt.join(spread, [key, "_salt"]).drop("_salt")
